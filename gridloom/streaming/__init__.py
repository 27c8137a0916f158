"""Structured Streaming forms of the session's logs."""
