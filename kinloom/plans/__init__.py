"""Pluggable models and whole analyses."""
