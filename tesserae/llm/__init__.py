"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a lazily evaluated DataFrame; intermediate tables that must not be
recomputed are written to the shared checkpoint folder (``shared.materialize``).
"""
