"""Streams of units stopped between batches and restarted from their checkpoint, against one run and against the batch operator."""

import random

import pytest

from spanview.operators import registry
from spanview.streaming import units

SCHEMA = "session string, turn long, seq long, path string, scope string, selector string, start_line int, end_line int, content string, pinned boolean"


def reads(n=400):
    r = random.Random(8)
    rows = []
    for i in range(n):
        path, scope = r.choice("abc") + ".py", r.choice(["file", "region"])
        rows.append((r.choice(["s", "t", "u"]), i // 3, i, path, scope, None, 1, 1 if scope == "file" else r.randrange(1, 4), f"text {r.randrange(3)}", r.random() < 0.05))
    return rows


@pytest.fixture
def files(spark, tmp_path):
    """The reads in order, a file for each part."""
    units.store(spark)
    rows = reads()
    for i in range(8):
        spark.createDataFrame(rows[50 * i : 50 * (i + 1)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    return str(tmp_path)


def run(spark, base, name, parts, stop_after=None):
    """Process what is there; with stop_after, so many parts of it only."""
    import glob
    import os
    import shutil

    source = f"{base}/{name}-source"
    os.makedirs(source, exist_ok=True)
    for i in parts:
        for f in glob.glob(f"{base}/in/part{i}/*.parquet"):
            to = f"{source}/{i:03d}-{os.path.basename(f)}"
            shutil.copy(f, to)
            os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))  # the source takes files in order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(source)
    q = units.tracked_units(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/{name}-checkpoint").option("path", f"{base}/{name}-out").trigger(availableNow=True).start()
    q.awaitTermination()


COLUMNS = ["session", "seq", "unit_id", "revision", "change_count", "changed_at", "pinned"]


def test_a_cut_run_gives_the_rows_of_an_uncut_one(spark, files):
    run(spark, files, "whole", range(8))
    for parts in ([0, 1, 2], [3], [4, 5, 6, 7]):
        run(spark, files, "cut", parts)
    whole, cut = (sorted(map(tuple, spark.read.parquet(f"{files}/{n}-out").select(COLUMNS).collect())) for n in ("whole", "cut"))
    batch = sorted(map(tuple, registry.tracked(spark.createDataFrame(reads(), SCHEMA)).select(COLUMNS).collect()))
    assert whole == cut == batch and len(whole) == 400
    # What is in state is the last row of each unit, and the same for both.
    last = {}
    for x in sorted(batch, key=lambda x: x[1]):
        last[x[0], x[2]] = (x[3], x[4], x[5], x[6])
    for name in ("whole", "cut"):
        saved = units.saved_units(spark, f"{files}/{name}-checkpoint").collect()
        assert {(x.session, x.unit_id): (x.revision, x.change_count, x.changed_at, x.pinned) for x in saved} == last


def test_a_repeated_read_changes_nothing(spark, files):
    run(spark, files, "again", [0, 1])
    import glob
    import os
    import shutil

    for f in glob.glob(f"{files}/in/part0/*.parquet"):
        shutil.copy(f, f"{files}/again-source/999-{os.path.basename(f)}")
    before = sorted(map(tuple, units.saved_units(spark, f"{files}/again-checkpoint").collect()))
    run(spark, files, "again", [])
    assert sorted(map(tuple, units.saved_units(spark, f"{files}/again-checkpoint").collect())) == before
    assert spark.read.parquet(f"{files}/again-out").count() == 150


def test_idle_sessions_are_forgotten(spark, files):
    import time

    source, at = f"{files}/idle-source", f"{files}/idle-checkpoint"
    spark.createDataFrame(reads()[:50], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = units.tracked_units(stream, "2 seconds").writeStream.format("noop").option("checkpointLocation", at).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        seen = False
        while time.time() < until:
            time.sleep(1)
            if not q.recentProgress or not any(p["numInputRows"] for p in q.recentProgress):
                continue
            left = units.saved_units(spark, at).count()
            seen = seen or left > 0
            if not left:
                break
        assert not left
    finally:
        q.stop()
