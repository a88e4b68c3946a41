"""Operators for preparing training data (optional subpackage).

Nothing outside this folder imports it; it may be deleted without affecting
the rest of the library.
"""
