"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator takes and
returns DataFrames; the column names that hold the id and the text are
parameters, and other columns of the input never clash with those it makes.
"""
