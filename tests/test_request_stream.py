"""The spool of requests: each line once over restarts and failed batches, malformed ones apart."""

import json
import os

import pytest

from spanview.sources import request_stream


def put(folder, name, lines):
    """A file that appears whole."""
    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    hidden = f"{os.path.dirname(path)}/.{os.path.basename(path)}"
    with open(hidden, "wb") as f:
        f.write("\n".join(lines).encode() if isinstance(lines, list) else lines)
    os.rename(hidden, path)


def run(spark, spool, base):
    q = request_stream.requests(request_stream.lines(spark, spool)).select("file", "line", "value", "malformed").writeStream.format("parquet")
    q.option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()


def rows(spark, base):
    return sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()), key=repr)


def test_each_request_once_over_restarts(spark, tmp_path):
    spool, base = f"{tmp_path}/spool", str(tmp_path)
    put(spool, "001.jsonl", [json.dumps({"id": 1}), "{broken", "", json.dumps([1]), '"text"'])
    put(spool, "002/a.jsonl", [json.dumps({"id": i}) for i in range(50)])
    run(spark, spool, base)
    first = rows(spark, base)
    assert len(first) == 54 and [r[1] for r in first if r[0] == "001.jsonl" and r[3]] == [2, 4, 5]
    run(spark, spool, base)
    assert rows(spark, base) == first
    put(spool, "000-late.jsonl", [json.dumps({"id": "never"})])
    put(spool, "003.jsonl", ['{"id": "ü"}\r', json.dumps({"id": "x" * 3_000_000}), "no end"])
    run(spark, spool, base)
    more = rows(spark, base)
    assert len(more) == 57 and ("003.jsonl", 1, '{"id": "ü"}', False) in more and ("003.jsonl", 3, "no end", True) in more
    assert not any("never" in (r[2] or "") for r in more)


def test_a_failed_batch_is_read_again(spark, tmp_path):
    spool, base, seen = f"{tmp_path}/spool", str(tmp_path), []
    put(spool, "1.jsonl", ['{"a": 1}', '{"a": 2}'])
    fails = [True]

    def sink(df, batch):
        seen.append((batch, sorted(x.value for x in df.collect())))
        if fails.pop() if fails else False:
            raise RuntimeError("the sink is down")

    def start():
        return request_stream.lines(spark, spool).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="sink is down"):
        start().awaitTermination()
    put(spool, "2.jsonl", ['{"a": 3}'])
    start().awaitTermination()  # runs the batch that failed again, as it was
    start().awaitTermination()
    assert seen[0] == seen[1] == (0, ['{"a": 1}', '{"a": 2}']) and seen[2:] == [(1, ['{"a": 3}'])]


def test_batch_limits_and_empty_folders(spark, tmp_path):
    spool = f"{tmp_path}/spool"
    assert request_stream.lines(spark, spool, streaming=False).count() == 0
    put(spool, "1", b"short\n" + b"x" * 5_000_000 + b"\nafter\n\n\xff\n")
    spark.dataSource.register(request_stream.RequestSpool)
    got = spark.read.format("request_spool").option("path", f"file://{spool}").option("limit", "1000000").load().collect()
    assert [(x.line, x.value) for x in got] == [(1, "short"), (2, None), (3, "after"), (5, "�")]
