"""Operators for training corpora; nothing outside this package imports them."""
