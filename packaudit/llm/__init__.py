"""Operators for preparing training data, each a DataFrame -> DataFrame function.

Nothing else in the library imports this subpackage.
"""
