"""Operators for training-data pipelines: deduplication, packing, scoring, tokenization."""
