"""Operators of a training-data pipeline: documents in, decisions, pieces, spans or records out."""
