"""Operators of a training-data pipeline: quality, duplicates, extraction, privacy, tokens."""
