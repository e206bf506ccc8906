"""Writes by events: seconds are rounded as the SQL rounds them, and events of nobody belong to no session."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from spanview import registry


def _same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = sorted(map(repr, want.fetchall()))
    return want, sorted(repr(tuple(x)) for x in registry.queries()[name](spark, folder).select(*columns).collect())


def test_parts_of_seconds_and_null_sessions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = []
    # A write heard of 1,000 s later; what follows at 999.7 s is of the second 1,000.
    for i, (user, first, last) in enumerate([(1, 0.2, 999.7), (2, 0.5, 1000.5), (3, 1.5, 1001.4), (None, 0.2, 1500.7)]):
        for event, at, kind in ((1000 * i + 1, first, "view"), (1000 * i + 500, last, "view"), (1000 * i + 600, last, "purchase")):
            rows.append((event, start + datetime.timedelta(seconds=at), user, kind, 60.0, '{"k": 0}'))
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    types = [pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64(), pa.string()]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names), f"{tmp_path}/events.parquet")
    for name in ("lost_changes", "external_writes"):
        want, got = _same(spark, str(tmp_path), name)
        assert got == want and len(want) > 0, name
