"""Operators for large training-data pipelines over documents, conversations and embeddings."""
