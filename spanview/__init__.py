"""Versioned text-span analytics on Spark DataFrames."""
