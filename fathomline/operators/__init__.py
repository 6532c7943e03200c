"""Relational operators: pure functions from DataFrames to DataFrames.

None of them collects rows or caches; state tables come in and go out whole.
"""
