"""Scans, sinks and table maintenance."""
