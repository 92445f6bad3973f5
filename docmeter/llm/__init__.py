"""Operators for training data made of language: pairs, cut texts, labels, names, tokens, mixes and abuse."""
