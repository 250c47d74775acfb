"""Operators of a training-data pipeline: scoring, near-duplicate search, mixing, packing."""
