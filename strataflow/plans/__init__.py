"""Retrieval planning and controlled retrieval."""
