"""Corpus-preparation operators for training data: mixing, packing, deduplication, scoring, extraction and search."""
