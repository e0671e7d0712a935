"""Operators for large text corpora; ``queries`` holds the registered queries over the test tables."""
