"""Operators of a training-data pipeline: dedup, scoring, mixing, sharding, packing, search.

Nothing else in the library imports this package. Every operator takes and
returns DataFrames; where it has to return whole input rows next to its own
columns it puts them into one struct, so that no column name can clash.
"""
