"""Operators for training-data pipelines.

Nothing else in the package imports this subpackage. Every operator takes a DataFrame that
holds the columns it names, selects those columns first (so extra columns cannot clash with
its own names) and returns a new DataFrame.
"""
