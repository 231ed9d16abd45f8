"""Operators for preparing very large training collections.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the library working.
"""
