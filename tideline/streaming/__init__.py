"""Structured Streaming over the run log and the documents."""
