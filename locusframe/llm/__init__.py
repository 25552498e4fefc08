"""Operators of a training-data pipeline: deduplication, tokens, packing, sharding, scoring, language, search."""
