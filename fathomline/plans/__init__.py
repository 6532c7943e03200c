"""Queries over the given tables, each built from the operators and paired with DuckDB SQL."""
