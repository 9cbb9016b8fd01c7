"""Operators for preparing large text corpora, one module each.

Nothing else in the library imports this subpackage.
"""
