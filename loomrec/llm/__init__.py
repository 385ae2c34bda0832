"""Operators for training-corpus pipelines (sharding, scoring, encoding, filtering, dedup, packing)."""
