"""Operators for training-data pipelines: search, deduplication, filtering, decontamination and packing.

Nothing outside this subpackage imports it. Every operator takes DataFrames and column names as parameters, reads only the
columns that it needs, and so ignores extra columns whatever their names.
"""
