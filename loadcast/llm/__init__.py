"""Operators for building training corpora from raw documents.

Each module holds one operator with its own interface; ``queries`` applies them to the test tables.
Nothing outside this package imports it.
"""
