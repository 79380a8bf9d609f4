"""Change feeds over Structured Streaming."""
