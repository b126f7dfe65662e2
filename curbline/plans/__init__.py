"""Compositions and the query registry."""
