"""Relocation cases, and the relations of its steps against the whole decision."""

import random

import pytest
from pyspark.sql import functions as F

from spanview.operators import relocate as ops
from spanview.relocation import Anchors, normal, relocate


def moved(previous: str, current: str, start: int = 1):
    f = relocate(previous, current, Anchors.of(previous, start))
    return f.state, f.method, f.start_line, f.end_line


@pytest.mark.parametrize(
    "previous, current, start, want",
    [
        ("a\nb\nc", "x\na\nb\nc\ny", 2, ("resolved", "exact", 2, 4)),
        ("a\nb\nc", "x\nx\na\nb\nc", 2, ("resolved", "exact", 3, 5)),
        ("a\nb\nc", "a\nB\nc\nd", 1, ("resolved", "boundary-anchors", 1, 3)),
        ("a\nb\nc", "q\nr", 1, ("unresolved", "anchors-not-found", None, None)),
        ("", "q", 1, ("unresolved", "missing-boundary-anchor", None, None)),
        ("a\nb\nc", "a\nb\nc\nz\na\nb\nc", 1, ("resolved", "boundary-anchors", 1, 3)),
        ("a\nb\nc", "a\nX\nc\nz\na\nY\nc", 3, ("unresolved", "ambiguous-boundary-anchors", None, None)),
        ("a\nb\nc\nd", "q\nq\nq\na\nd", 1, ("unresolved", "displaced-shrunk-boundary-anchors", None, None)),
        ("a\nb\n}", "a\nb\nnew\n}", 1, ("resolved", "boundary-anchors", 1, 3)),
        ("head\nunique one\nunique two\nend", "HEAD\nunique one\nunique two\nend", 1, ("resolved", "structural-anchors", 1, 4)),
        ("a\r\nb", "a\nb", 1, ("resolved", "boundary-anchors", 1, 2)),
    ],
)
def test_cases(previous, current, start, want):
    assert moved(previous, current, start) == want


def _pairs(current, a):
    own = [normal(x) for x in current.split("\n")]
    every = [(abs(e - s + 1 - a.line_count), abs(s + 1 - a.start_line), s, e) for s, x in enumerate(own) if x == a.first for e, y in enumerate(own) if e >= s and y == a.last]
    return sorted(every)


def test_boundary_pairs_find_the_best_of_all_pairs(spark):
    r = random.Random(5)
    rows, want = [], {}
    for i in range(150):
        current = "\n".join(r.choice("ab}{c ") for _ in range(r.randrange(1, 14)))
        previous = "\n".join(r.choice("ab}") for _ in range(r.randrange(1, 5)))
        start = r.randrange(1, 8)
        a = Anchors.of(previous, start)
        rows.append((i, previous, current, start))
        every = _pairs(current, a) if a.first else []
        if every:
            want[i] = (*every[0][2:], len(every) > 1 and every[0][:2] == every[1][:2])
    df = spark.createDataFrame(rows, "id int, content string, current string, start_line int").withColumn("anchors", ops.anchors(F.col("content"), F.col("start_line")))
    got = {x.id: (x.start_at, x.end_at, x.tied) for x in ops.boundary_pairs(df, ["id"]).filter("rank = 1").collect()}
    assert got == want


def test_relocated_keeps_missing_files_unresolved(spark):
    units = spark.createDataFrame([("s", "u", "f", "region", None, "a\nb", 1, 2, None), ("s", "v", "g", "file", None, "a", 1, 1, None), ("s", "w", "f", "region", None, "zz", 2, 2, 3)],
                                  "session string, unit_id string, path string, scope string, selector string, content string, start_line int, end_line int, file_lines int")
    files = spark.createDataFrame([("s", "f", "a\nB\nc")], "session string, path string, content string")
    got = {x.unit_id: (x.state, x.method, x.new_content) for x in ops.relocated(units, files).collect()}
    assert got == {"u": ("unresolved", "anchors-not-found", None), "v": ("unresolved", "source-missing", None), "w": ("resolved", "stored-line-span", "B")}
    assert ops.relocated(units.limit(0), files).count() == 0
