"""Bytes that two texts share at both ends: against byte strings, and each text encoded once a row."""

import random
import re

from spanview.functions import text
from spanview.operators import metrics


def brute(a, b):
    a, b = a.encode(), b.encode()
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    c, d = a[start:][::-1], b[start:][::-1]
    end = next((i for i, (x, y) in enumerate(zip(c, d)) if x != y), min(len(c), len(d)))
    return start, max(len(a), len(b)) - start - end


def test_as_byte_strings(spark):
    r = random.Random(3)
    rows = [("", ""), ("", "a"), ("aa", "aaa"), ("é", "è"), ("€", "é"), ("a" * 70_000, "a" * 69_999 + "b"), ("x" * 65_536, "x" * 65_536)]
    for _ in range(300):
        a = "".join(r.choice("ab€é") for _ in range(r.randrange(40)))
        at = r.randrange(len(a) + 1)
        rows.append((a, a[:at] + r.choice(["", "b", "aé"]) + a[at + r.randrange(3) :]))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", text.common_prefix_bytes(df.a, df.b).alias("p"), metrics.changed_bytes(df.a, df.b).alias("c")).collect()
    assert all((g.p, g.c) == brute(g.a, g.b) for g in got) and len(got) == len(rows)
    # A text that is not there shares nothing.
    empty = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [tuple(x) for x in empty.select(text.common_prefix_bytes(empty.a, empty.b), metrics.changed_bytes(empty.a, empty.b)).collect()] == [(0, 1)] * 2


def test_no_text_is_encoded_again_inside_a_loop(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = df.select(metrics.changed_bytes(df.a, df.b).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"encode\(", plan)) <= 2 and "hex(" not in plan
