"""Operators of a training-data pipeline: tokenizing, sharding, deduplication, scoring and packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
