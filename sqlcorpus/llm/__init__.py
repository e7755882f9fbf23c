"""Operators for training-data pipelines over documents and conversations.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; ``queries`` registers the thin queries over them.
"""
