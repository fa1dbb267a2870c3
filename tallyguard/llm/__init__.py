"""Operators of a training-data pipeline over text, url and conversation tables."""
