"""Pairs, graphs, communities, reports, search, catalogue."""
