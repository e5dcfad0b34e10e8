"""Scans, sinks and document sources."""
