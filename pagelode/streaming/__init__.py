"""Structured Streaming forms: polling cursors, quotas, windows."""
