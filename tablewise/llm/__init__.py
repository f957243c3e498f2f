"""Operators of a training-data pipeline over texts, pages and embeddings."""
