"""Operators for training data: names, page bodies, text forms, duplicates, sentences, splits, token ids, leaks, cuts."""
