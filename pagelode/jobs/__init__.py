"""Command line jobs."""
