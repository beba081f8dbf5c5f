"""Operators of a training-data pipeline: dedup, models, search, screening, packing."""
