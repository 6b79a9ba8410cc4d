"""Corpus curation and experiment analytics as Spark DataFrame operators."""
