"""Continuous ingest of raw corpora."""
