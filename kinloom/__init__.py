"""Kinloom: a PySpark engine that weaves tables of people into weighted graphs and mines them."""
