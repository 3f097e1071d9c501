"""Operators of a training-data pipeline: tokenising, token files, WARC,
chat formatting, deduplication, mixing, quality rules and secret scans.

Nothing else in the library imports this subpackage.  Every operator lives in
a module of its own and takes and returns DataFrames; ``registry`` binds the
thin ``opN_<name>`` queries to the given tables.
"""
