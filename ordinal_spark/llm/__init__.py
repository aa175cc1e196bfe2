"""Operators for building training corpora (one module each) and their queries.

Nothing else in the package imports this subpackage.
"""
