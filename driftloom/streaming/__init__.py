"""The scoring path as Structured Streaming."""
