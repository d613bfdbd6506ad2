"""Corpus preparation for language-model training: the ten dealt operators."""
