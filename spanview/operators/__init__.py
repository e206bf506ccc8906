"""Operators over DataFrames of sessions, units, messages, captures and facts."""
