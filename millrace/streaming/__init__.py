"""The same nodes on Structured Streaming."""
