"""Corpus fingerprint analytics on Spark."""
