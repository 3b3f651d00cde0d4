"""Operators of a training-data pipeline: deduplication, filtering, extraction, counting, packing."""
