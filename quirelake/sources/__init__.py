"""Readers and per-source parsers that produce the one record schema."""
