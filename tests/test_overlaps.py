"""Overlapping reads against counts line by line and against every choice of reads."""

import itertools
import random

from spanview.operators import overlaps

READS = "session string, path string, first int, last int, read_id long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sweep_by_lines(spark):
    r = random.Random(3)
    keys = [(s, p) for s in ("s", "t", None) for p in ("a", "b", None)]
    reads = [(*r.choice(keys), a, a + r.randrange(-1, 6), i) for i in range(160) for a in [r.randrange(1, 30)]] + [("s", "a", None, 3, 900), ("s", "a", 3, None, 901)] + [("s", "hot", 2, 5, 1000 + i) for i in range(400)]
    files = [("a", "\n".join("é" * (i % 5) for i in range(25))), ("hot", "1\n22\n333\n4444\n"), ("unread", "x"), ("b", None)]
    df, f = spark.createDataFrame(reads, READS), spark.createDataFrame(files, "path string, content string")
    count = {}
    for s, p, a, z, _ in reads:
        for i in range(a or 1, (z or 0) + 1) if a and z else ():
            count[s, p, i] = count.get((s, p, i), 0) + 1
    lines = {p: (c or "").split("\n") for p, c in files}
    size = lambda p, i: len(lines[p][i - 1].encode()) + (i < len(lines[p])) if p in lines and 1 <= i <= len(lines[p]) else 0
    got = {}
    for x in overlaps.stretches(df).collect():
        for i in range(x.first, x.last + 1):
            assert (x.session, x.path, i) not in got
            got[x.session, x.path, i] = x.depth
    assert got == count
    spans = overlaps.covered(df).collect()
    assert {(x.session, x.path, i) for x in spans for i in range(x.first, x.last + 1)} == set(count)
    for x in spans:
        assert (x.session, x.path, x.first - 1) not in count and (x.session, x.path, x.last + 1) not in count
    for x in overlaps.report(df, f).collect():
        mine = {i: n for (s, p, i), n in count.items() if (s, p) == (x.session, x.path)}
        assert x.covered_bytes == sum(size(x.path, i) for i in mine) and x.repeated_bytes == sum(size(x.path, i) * (n - 1) for i, n in mine.items())
        assert x.reads == sum(1 for s, p, a, z, _ in reads if (s, p) == (x.session, x.path) and a and z and a <= z)
        assert x.spans == sum(i - 1 not in mine for i in mine)
        cover = sorted({(a, z) for s, p, a, z, _ in reads if (s, p) == (x.session, x.path) and a and z and a <= z})
        if x.path == "hot":
            assert x.needed == 1


def test_fewest_reads_by_every_choice(spark):
    r, rows, want = random.Random(4), [], {}
    for k in range(60):
        spans = [(a, a + r.randrange(0, 7)) for a in (r.randrange(1, 18) for _ in range(r.randrange(1, 9)))]
        rows += [("s", f"p{k}", a, z, i) for i, (a, z) in enumerate(spans)]
        union = {i for a, z in spans for i in range(a, z + 1)}
        want[f"p{k}"] = next(n for n in range(1, 10) if any({i for a, z in c for i in range(a, z + 1)} == union for c in itertools.combinations(spans, n)))
    chosen = {}
    for x in overlaps.needed(spark.createDataFrame(rows, READS)).collect():
        chosen.setdefault(x.path, []).append(x.read_id)
    spans = {(p, i): (a, z) for _, p, a, z, i in rows}
    for path, ids in chosen.items():
        assert len(ids) == want[path] == len(set(ids))
        assert {i for k in ids for i in range(spans[path, k][0], spans[path, k][1] + 1)} == {i for (p, _), (a, z) in spans.items() if p == path for i in range(a, z + 1)}
    assert set(chosen) == set(want)


def test_empty_tables(spark):
    reads, files = spark.createDataFrame([], READS), spark.createDataFrame([], "path string, content string")
    assert overlaps.report(reads, files).count() == 0 and overlaps.needed(reads).count() == 0 and overlaps.covered(reads).count() == 0
