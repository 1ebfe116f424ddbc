"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads only the columns it names (extra columns are ignored) and
states in its docstring what it does with nulls, empty texts, ties and empty
tables.
"""
