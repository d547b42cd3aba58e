"""Readers, writers and feed sources."""
