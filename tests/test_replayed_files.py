"""Traces replayed where they are made: the same measures as of traces that are rows, from tasks that share the files evenly."""

import pyarrow as pa
from pyspark.sql import functions as F

from spanview.operators import replay
from spanview.plans import replays

FILES = [(f"n{i}", f"f{i}.txt", "\n".join(f"line {i} {j % (5 if i % 3 else 100)}" for j in range(3 + i % 9))) for i in range(40)] + [("null", "x", None), ("short", "y", "a\nb")]


def _files(spark):
    return spark.createDataFrame(FILES, "name string, path string, content string").coalesce(1)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_as_traces_that_are_rows(spark):
    files = _files(spark)
    make, traces = replay.region_traces(2, 4), replay.generated(files, 2, 4)
    got = _rows(replay.replayed_files(files, make))
    assert got == _rows(replay.replayed(traces)) and len(got) > 1000
    assert _rows(replay.replayed_files(files, replay.pressed(make), ("unit-region", "whole-file"))) == _rows(replay.replayed(replay.under_pressure(traces), ("unit-region", "whole-file")))


def test_files_of_one_partition_are_shared_and_rows_come_in_whole_batches(spark):
    out = replay.replayed_files(_files(spark), replay.region_traces(2, 4))
    places = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(places) > spark.sparkContext.defaultParallelism and max(x["count"] for x in places) < out.count() / 4
    seen = replay.replayed(replay.generated(_files(spark), 2, 4)).mapInArrow(lambda batches: iter([pa.RecordBatch.from_pylist([{"n": b.num_rows} for b in batches])]), "n long").collect()
    assert max(x.n for x in seen) > 100


def test_documents_are_dealt_out_and_edited_where_they_are_replayed(spark, tmp_path):
    """document_replay over one file that cannot be split: the edits of _regions, in tasks that share the documents."""
    texts = [None, "", "a", "a\nb\nc", "\n\n\n", "one\ntwo $& x\nthree $$\nfour\n", "x\r\ny\r\nz\r\nw\r\n", "p\nq\nq\nq\nr\np\nq"]
    rows = [(i * 14 + k - 7, t) for i, t in enumerate(texts) for k in range(14)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    task, none = F.lit(replays.TASK), dict.fromkeys(replay._EVENT_FIELDS, F.lit(None))

    def event(**values):
        return F.struct(*(v.alias(k) for k, v in {**none, **values}.items())).cast(replay.EVENT)

    shot = event(type=F.lit("capture-request"), task=task, budget=F.lit(12_000))
    edit = event(type=F.lit("replace-exact"), path=F.lit("f"), expected=F.col("t"), replacement=F.replace("current", F.lit("$"), F.lit("$$")))
    read = event(type=F.lit("read"), path=F.lit("f"), scope=F.lit("region"), start_line=F.lit(2), end_line=F.lit(4))
    traces = replays._regions(spark, tmp_path).select(F.concat(F.lit("docs/edit/"), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("repository"), F.create_map(F.lit("f"), F.col("t")).alias("files"), F.array(read, shot, edit, shot).alias("events"))
    out = replays.document_replay(spark, tmp_path)
    want = replay.replayed(traces, ("unit-region",)).select(*out.columns)
    # Two captures each, and one error for each text whose CRLF is not in its normal form.
    assert _rows(out) == _rows(want) and want.count() == 2 * len(rows) - 14
    assert out.groupBy(F.spark_partition_id()).count().count() > spark.sparkContext.defaultParallelism
