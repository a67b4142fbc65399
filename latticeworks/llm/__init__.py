"""Operators for training-data pipelines: documents in, decisions or rows out."""
