"""Operators of a training-data pipeline over (doc_id, text, ...) tables."""
