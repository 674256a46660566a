"""Operators for building language-model training corpora.

Every operator takes and returns DataFrames. ``queries`` applies each of them to
the sample tables; nothing outside this package imports it.
"""
