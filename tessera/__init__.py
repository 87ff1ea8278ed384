"""Listing analytics on Spark: clean, dedup, compare and score marketplace listings."""
