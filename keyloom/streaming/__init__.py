"""Structured Streaming forms of expiry, waiting, notifications and statistics."""
