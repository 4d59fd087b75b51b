"""Scans, sinks and keyed tables."""
