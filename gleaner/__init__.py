"""Corpus retrieval and evidence analytics as PySpark DataFrame operators."""
