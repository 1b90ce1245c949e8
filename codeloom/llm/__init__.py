"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  Every operator works on whole
tables and whole texts, keeps its Python part behind Arrow batches, and states
in its docstring what nulls, empty texts, ties, repeated rows, empty tables and
clashing column names give.
"""
