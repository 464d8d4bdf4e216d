"""Operators of a training-data pipeline over text, embedding, page and conversation tables."""
