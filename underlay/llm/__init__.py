"""Training-data operators over text and vector tables.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names, selects only the columns it was told about (so extra columns
with clashing names never matter) and treats a null text as an empty one.
"""
