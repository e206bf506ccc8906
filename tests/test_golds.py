"""Gold texts of required units with what quarantines a trace, payloads that read again, and prices of cached prompts."""

import hashlib

import pytest

from spanview.operators import ledger, replay


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_gold_of_required_units(spark):
    files = [("t", "a", "one\ntwo\nthree"), ("t", "b", "whole"), ("u", "a", "")]
    reads = [("t", 2, "a", "s", "region", 2, 3, "two\nthree"), ("t", 3, "a", "s", "region", 1, 1, "one"), ("t", 1, "a", "x", "file", 1, 3, "one\ntwo\nthree"), ("t", 5, "a", None, "region", 3, 3, "three")]
    required = [
        ("t", "a", "s", sha("two\nthree")), ("t", "a", None, sha("one\ntwo\nthree")), ("t", "b", None, sha("whole")), ("t", "a", "unread", sha("one\ntwo\nthree")),
        ("t", "gone", None, sha("x")), ("u", "a", None, sha("")), ("v", "a", None, None), ("w", "b", None, sha("y")),
    ]
    df = replay.required_gold(
        spark.createDataFrame(required, "trace string, path string, selector string, sha256 string"),
        spark.createDataFrame(reads, "trace string, seq int, path string, selector string, scope string, start_line int, end_line int, initial string"),
        spark.createDataFrame([*files, ("w", "b", "z")], "trace string, path string, content string"),
    )
    got = {(x.trace, x.path, x.selector): (x["scope"], x.gold, x.error) for x in df.collect()}
    assert got == {
        ("t", "a", "s"): ("region", "two\nthree", None), ("t", "a", None): ("file", "one\ntwo\nthree", None), ("t", "b", None): ("file", "whole", None), ("t", "a", "unread"): ("file", "one\ntwo\nthree", None),
        ("t", "gone", None): ("file", None, "missing"), ("u", "a", None): ("file", "", "missing"), ("v", "a", None): ("file", None, "missing"), ("w", "b", None): ("file", "z", "mismatch"),
    }
    kept, held = replay.quarantined(df)
    assert kept.count() == 0 and {x.trace: (x.errors, x.paths) for x in held.collect()} == {"t": (["missing"], 1), "u": (["missing"], 1), "v": (["missing"], 1), "w": (["mismatch"], 1)}
    kept, held = replay.quarantined(df.filter("path != 'gone'"))
    assert kept.count() == 4 and held.count() == 3


def test_payloads_that_read_again(spark):
    reads = spark.createDataFrame([("t", 1, "b", "old b"), ("t", 2, "a", "old a"), ("t", 3, "b", "newer b"), ("t", 4, "gone", "g")], "trace string, seq int, path string, content string")
    files = spark.createDataFrame([("t", "a", "now a"), ("t", "b", "now b"), ("t", "unread", "u")], "trace string, path string, content string")
    captures = spark.createDataFrame([("t", "go"), ("none", "go")], "trace string, task string")
    assert [tuple(x) for x in replay.reread_payloads(reads, captures, files).collect()] == [("t", "old b\n\nold a\n\nnewer b\n\ng\n\nnow b\n\nnow a\n\nTASK: go")]


def test_prices_with_a_cache(spark):
    rows = [("a", 100, 40, 10), ("a", 10, 500, None), ("b", None, None, None), ("b", 50, -3, 1)]
    out = {x.arm: (x.requests, x.hit_tokens, x.miss_tokens, x.completion_tokens, x.usd) for x in ledger.cached_spend(spark.createDataFrame(rows, "arm string, prompt_tokens long, hit_tokens long, completion_tokens long"), 1.0, 10.0, 100.0).collect()}
    assert out["a"][:4] == (2, 50, 60, 10) and out["b"][:4] == (2, 0, 50, 1) and out[None][:4] == (4, 50, 110, 11)
    assert out[None][4] == pytest.approx((50 + 1100 + 1100) / 1e6)
