"""Operators for training-data pipelines: each takes a DataFrame and returns one.

Nothing else in the library imports this subpackage.
"""
