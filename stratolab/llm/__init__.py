"""Operators that prepare training text, pages and vectors at scale.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
