"""Operators for preparing language-model training data at cluster scale.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; `queries` holds the registered queries.
"""
