"""Operators for preparing training data: dedup, search, language, tokens, quality, mixing.

Nothing else in the library imports this subpackage.
"""
