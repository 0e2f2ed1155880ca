"""Operators for preparing training text: joins on word n-grams, token counts, packing, classifiers and more.

Nothing outside this package imports it.
"""
