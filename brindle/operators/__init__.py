"""Relational operators over the retrieval tables."""
