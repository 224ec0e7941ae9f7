"""Operators for building language-model training data.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered ``opN_*`` queries.  Operators select the columns they need first, so
extra columns of the input (also ones named like an internal column) are
ignored unless a docstring says that they pass through.
"""
