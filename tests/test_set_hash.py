"""Hashes of sets that are streamed in order."""

import hashlib
import random

from spanview.operators import provenance


def test_as_joined_lines(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.randrange(3), r.choice([None, "x", "y", "é", *[f"n{i}" for i in range(50)]]), r.choice([None, "", "text", "語"])) for _ in range(600)]
    rows += [("many", 0, f"k{i:05d}", "t") for i in range(5000)] + [(f"s{i}", 1, "x", "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, name string, content string").repartition(7)
    sets = {}
    for k, n, name, content in rows:
        line = None if name is None or content is None else f"{name}:{hashlib.sha256(content.encode()).hexdigest()}"
        sets.setdefault((k, n), []).append(((name is None, name or ""), (line is None, line or "")))
    want = {key: (len(v), hashlib.sha256("\n".join(x for _, (none, x) in sorted(v) if not none).encode()).hexdigest()) for key, v in sets.items()}
    got = {(x.k, x.n): (x.members, x.set_sha256) for x in provenance.set_hash(df, ["k", "n"], "name", "content").collect()}
    assert got == want
    assert provenance.set_hash(df.limit(0), ["k", "n"], "name", "content").count() == 0
