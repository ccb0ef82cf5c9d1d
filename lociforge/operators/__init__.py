"""Operators over DataFrames: cohort statistics, records, generation, sizing, summaries, references."""
