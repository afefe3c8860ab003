"""Operators for preparing large text corpora.

Nothing outside this package imports it; removing the folder leaves the rest
of the library intact.
"""
