"""Operators for text corpora and entity linkage; nothing outside imports this package."""
