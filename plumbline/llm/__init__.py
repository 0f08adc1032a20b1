"""Operators for preparing training data: text, tokens, duplicates, search and scoring.

Nothing else in the library imports this subpackage.
"""
