"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
