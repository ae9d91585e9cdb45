"""Readers and writers: raw logs, JSON lines, key/value entries."""
