"""Operators for preparing text corpora, each a Spark job over whole tables.

Nothing else in the package imports this subpackage.
"""
