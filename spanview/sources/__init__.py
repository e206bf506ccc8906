"""Readers and writers of the records that sessions, traces and reports come as."""
