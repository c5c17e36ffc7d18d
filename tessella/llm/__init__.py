"""Operators for training-data corpora: tokens, duplicates, language models, search and toxicity."""
