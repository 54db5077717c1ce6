"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; the thin ``opN_*`` queries are in :mod:`tankline.llm.queries`.
"""
