"""Sources and sinks: dated Markdown corpora, catalogs, specifications, logs, artifacts and market fixtures."""
