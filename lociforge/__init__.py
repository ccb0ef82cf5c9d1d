"""Variant analytics on Spark: read, classify, validate, summarize, generate and write variant cohorts."""
