"""Operators for training-data pipelines over a table of documents.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface (any id and text column); ``queries`` binds
the operators to the test tables.
"""
