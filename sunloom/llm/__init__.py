"""Operators of a training-data pipeline: tokenising, duplicates, scores, archives. Nothing else in the library imports them."""
