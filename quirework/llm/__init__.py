"""Operators for training text and embeddings; nothing outside this folder imports it."""
