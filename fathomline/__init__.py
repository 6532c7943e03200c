"""Opportunity analytics as Spark jobs over DataFrames."""
