"""The jobs over unbounded input, with Structured Streaming."""
