"""Operators for training-data corpora: near duplicates, packing, language, models, filters and tokenizers."""
