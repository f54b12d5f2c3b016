"""Structured Streaming variants of batch operators."""
