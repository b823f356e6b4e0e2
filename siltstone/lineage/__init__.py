"""Provenance of SQL statements: parsed where the rows are, related as DataFrames."""
