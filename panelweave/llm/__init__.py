"""Operators for preparing text corpora; each module holds one of them."""
