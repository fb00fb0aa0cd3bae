"""Operators for building language-model training sets from a table of documents.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and
returns DataFrames; `queries.py` applies them to the test tables.
"""
