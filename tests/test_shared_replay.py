"""Traces that begin alike, replayed together: the same measures as one by one, and what they share only once."""

import random
import re

from pyspark.sql import functions as F

from spanview import engine, relocation, replay
from spanview.operators import metrics
from spanview.operators import replay as operators
from spanview.plans import replays

TEXT = "one\ntwo é\nthree  x\nfour\nfive the region\ntwo é\n"


def _traces():
    return operators.region_traces(2, 4)("n", "f.txt", TEXT)


def test_together_as_one_by_one():
    traces = _traces()
    bad = {**traces[3], "events": [*traces[3]["events"][:2], operators.event("replace-exact", path="f.txt", expected="nowhere", replacement="x")]}
    for group in (traces, [*traces[:4], bad, *traces[4:]], [traces[0], traces[0]], [traces[0], {**traces[1], "files": {"f.txt": TEXT + "more"}}], [traces[2]], []):
        got = list(replay.run_all(group, replay.SYSTEMS))
        assert len(got) == len(group)
        for t, out in zip(group, got):
            for i, name in enumerate(replay.SYSTEMS):
                try:
                    assert replay.run(t["files"], t["events"], name) == out[i]
                except replay.TraceError as e:
                    assert str(e) == str(out) and t is bad
    # An error in what all share is that of each.
    wrong = [{**t, "files": {}} for t in traces]
    assert [str(e) for e in replay.run_all(wrong, ("unit-file",))] == ["no such file: f.txt"] * len(traces)


def test_what_traces_share_is_replayed_once(monkeypatch):
    seen, real = [], replay._System.capture
    monkeypatch.setattr(replay._System, "capture", lambda self, *a: seen.append(self.name) or real(self, *a))
    n = len(_traces())
    rows = list(operators._runs([_traces()], replay.SYSTEMS, None))
    assert len(rows) == 2 * n * len(replay.SYSTEMS) and len(seen) == (n + 1) * len(replay.SYSTEMS)


def test_columns_that_are_not_asked_for_stay(spark):
    files = spark.createDataFrame([("n", "f.txt", TEXT)], "name string, path string, content string")
    make, columns = operators.region_traces(2, 4), ("trace", "system", "capture", "error", "recall")
    whole = operators.replayed_files(files, make)
    got = operators.replayed_files(files, make, columns=columns)
    assert tuple(got.columns) == columns and sorted(map(repr, got.collect())) == sorted(map(repr, whole.select(*columns).collect()))


def test_terms_that_a_task_shares_and_normal_lines():
    r = random.Random(7)
    parts = ["the", "The", "re", "_", "9", "12", "é", "İ", "\n", " ", "-", "region", "x", "ΑΣ", "K"]
    odd = ["\t", "  ", "　", "﻿", "\xa0", "\x85", "\x1c", "\r", "a", "é", "語", " ", "\v", " "]
    for _ in range(4000):
        task, path, content = ("".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3))
        assert engine.shared_terms(task, path, "", content) == len(engine.terms(task) & engine.terms(f"{path}\n\n{content}")), (task, path, content)
        line = "".join(r.choice(odd) for _ in range(r.randrange(8)))
        want = re.sub(r"[\s﻿]+", " ", line).strip(" ")
        assert relocation.normal(line) == want and relocation.normal_lines([line, "b"], f"{line}\nb") == [want, "b"]


def test_last_captures_leave_alone(spark, tmp_path):
    """budget_pressure, repeated numbers and none among them, as of all captures with all columns."""
    texts = [TEXT, TEXT + "more", "a\nb\nc\nd\ne", "short", None]
    spark.createDataFrame([(i % 3 if i < 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files = replays._files(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    make, systems = operators.pressed(operators.region_traces(2, 4)), ("unit-region", "whole-file")
    whole = operators.replayed_files(files, make, systems)
    final = metrics.final_captures(whole, ["trace", "system"], "capture")
    want = final.groupBy("system").agg(F.count("*").alias("traces"), F.max("projection_bytes").alias("largest"), F.sum("stale_bytes").alias("stale_bytes"))
    assert sorted(map(tuple, replays.budget_pressure(spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))
    last = operators.replayed_files(files, make, systems, last=True)
    assert 2 * last.count() == whole.count() > 0 and {x.capture for x in last.select("capture").distinct().collect()} == {1}
