"""Queries that apply the operators to the driver's tables, each beside the SQL that checks it."""
