"""Operators for preparing text and embeddings as training data."""
