"""Corpus and text analytics as plain Spark DataFrame functions."""
