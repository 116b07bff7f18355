"""Operators of a training-data pipeline: counting, mixing, deduplicating and cleaning text."""
