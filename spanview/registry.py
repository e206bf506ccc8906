"""All queries of the library by name, each beside the SQL that checks it."""

from __future__ import annotations


def _modules() -> list:
    from .plans import files, measures, replays, requests, selection, sessions, snapshots, streams

    return [selection, sessions, measures, replays, files, snapshots, streams, requests]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
