"""Corpus-preparation operators for language-model training data."""
