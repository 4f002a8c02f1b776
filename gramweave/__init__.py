"""Gramweave: exact and approximate string matching over large text tables, on Spark."""
