"""Operators for text corpora that feed language-model training."""
