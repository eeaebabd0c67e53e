"""Training-data operators: quality, extraction, filtering, near copies, packing and more.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames
to a DataFrame; :mod:`docuweave.llm.queries` holds the thin registered queries.
"""
