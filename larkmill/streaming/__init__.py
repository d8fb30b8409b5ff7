"""Streams: append-only logs on Parquet, consumer groups, and Structured Streaming over them."""
