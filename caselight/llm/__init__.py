"""Operators for text corpora: cleaning, deduplication, tokens.

Nothing else in the library imports this folder.
"""
