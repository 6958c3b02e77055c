"""Operators for training data: grouping of matches, survivors, top N, tokenization, packing, sentences."""
