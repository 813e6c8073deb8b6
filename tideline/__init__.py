"""tideline: point-in-time document and time-series analytics on Spark DataFrames."""

__all__ = ["session"]
