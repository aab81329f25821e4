"""Scans, fetch/parse sources and vector sinks."""
