"""Structured Streaming variants of scans, watching and summaries."""
