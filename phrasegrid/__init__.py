"""Phrase catalogs, phrase matching and retrieval analytics as plain Spark plans."""
