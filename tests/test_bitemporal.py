"""Two times of writes against a comparison of every write with every question."""

import random

from pyspark.sql import functions as F

from spanview.operators import bitemporal

WRITES = "session string, path string, written long, seen long, writer string, seq long, content string, deleted boolean"
ASKS = "session string, ask long, at long, known_by long"


def brute(writes, asks):
    out = set()
    for session, ask, at, by in asks:
        if at is None or by is None:
            continue
        for path in {w[1] for w in writes if w[0] == session}:
            fit = [w for w in writes if w[0] == session and w[1] == path and w[2] is not None and w[3] is not None and w[2] <= at and w[3] <= by]
            if fit:
                b = max(fit, key=lambda w: (w[2], w[3], w[4], w[5]))
                out.add((session, ask, path, b[6], b[7], b[4], b[2], b[3]))
    return out


def test_as_every_pair(spark):
    r = random.Random(12)
    writes, asks = [], []
    for i in range(400):
        t = r.randrange(100)
        deleted = r.random() < 0.1
        writes.append((r.choice(["s", "t", None]), r.choice("ab") if i % 3 else "hot", t, t + r.choice([0, 0, 1, 7, 60]), r.choice(["me", "other"]), i, None if deleted else f"v{i}", deleted))
    writes += [("s", "a", None, 3, "me", 900, "x", False), ("s", "a", 3, None, "me", 901, "x", False), ("late", "z", 1, 500, "other", 902, "z", False)]
    for i in range(150):
        at = r.randrange(-5, 130)
        asks.append((r.choice(["s", "t", None, "none"]), i, at, r.choice([at, at, at + 20, at - 3])))
    asks += [("late", 900, 50, 499), ("late", 901, 50, 500), ("s", 902, None, 5), ("s", 903, 5, None)]
    got = bitemporal.known(spark.createDataFrame(writes, WRITES), spark.createDataFrame(asks, ASKS))
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(writes, asks) and len(rows) > 250


def test_a_file_of_many_writes(spark):
    n = 3000
    writes = [("s", "f", (i * 7919) % n, i, "w", i, str(i), False) for i in range(n)]
    asks = [("s", k, (k * 37) % n, (k * 101) % n) for k in range(120)]
    got = {tuple(x) for x in bitemporal.known(spark.createDataFrame(writes, WRITES), spark.createDataFrame(asks, ASKS)).collect()}
    assert got == brute(writes, asks)


def test_unknown_changes_of_others(spark):
    writes = [("s", "f", 1, 1, "me", 1, "a", False), ("s", "f", 2, 9, "other", 2, "b", False), ("s", "f", 5, 5, "me", 3, "c", False), ("s", "f", 6, 6, "other", 4, "d", False), ("s", "f", 7, 7, "me", 5, "e", False), ("s", "f", 8, 20, "other", 6, "f", False)]
    got = bitemporal.foreign_changes(spark.createDataFrame(writes, WRITES), F.col("writer") == "me").collect()
    assert [(x.seq, x.lost_to) for x in got] == [(2, 3)]


def test_empty_tables(spark):
    w, a = spark.createDataFrame([], WRITES), spark.createDataFrame([], ASKS)
    assert bitemporal.known(w, a).count() == 0 and bitemporal.known(w, spark.createDataFrame([("s", 1, 1, 1)], ASKS)).count() == 0
