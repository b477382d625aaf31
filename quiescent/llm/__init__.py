"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns DataFrames; the thin ``opN_*`` queries are in :mod:`.queries`.
"""
