"""Operators for training-data pipelines on text: duplicates, extraction, quality, mixing, tokens and search."""
