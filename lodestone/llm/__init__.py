"""Operators for building language-model training corpora, each a DataFrame -> DataFrame function.

Nothing else in the library imports this subpackage.
"""
