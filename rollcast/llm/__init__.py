"""Operators of a large-scale training-data pipeline.

One module per operator, each with a general interface over DataFrames, and
`queries.py` with the thin queries that apply them to whole tables. Nothing else
in the library imports this subpackage."""
