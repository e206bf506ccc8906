"""Readers and writers, from and to files of a test's own."""

import json

import pytest
from pyspark.sql import functions as F

from spanview import families, replay
from spanview.operators import replay as ops
from spanview.sources import readers, writers


def test_workspace_limits_and_lookups(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"x\r\ny")
    (tmp_path / "src/big.txt").write_bytes(b"z" * 600_000)
    (tmp_path / "nul.txt").write_bytes(b"a\0b")
    assert {r.path: r.content for r in readers.live_files(spark, str(tmp_path)).collect()} == {"src/a.py": "x\ny"}
    assert {r.path: r.reason for r in readers.source_walk(spark, str(tmp_path)).collect()} == {"src/a.py": None, "src/big.txt": "parser-not-implemented", "nul.txt": "parser-not-implemented"}
    wanted = spark.createDataFrame([("./src/a.py",), ("gone",)], "path string")
    assert {r.path: r.content for r in readers.looked_up(wanted, readers.workspace(spark, str(tmp_path))).collect()} == {"./src/a.py": "x\ny", "gone": None}


def test_trace_files_round_trip_and_replay(spark, tmp_path):
    source = "a\n\ndef f():\n    x = 1\n    return x\n\nend\n"
    for i, t in enumerate(families.generate({"a.py": source}, "a.py", 3, 5)):
        names = {"start_line": "startLine", "end_line": "endLine", "budget": "budgetChars", "required": "requiredUnits"}
        events = [{names.get(k, k): v for k, v in e.items() if v is not None} for e in t["events"]]
        (tmp_path / f"t{i}.json").write_text(json.dumps({"schemaVersion": 1, "name": t["name"], "source": {"repository": "https://x/flask.git", "commit": "c"}, "initialFiles": t["files"], "events": events}, indent=1))
    (tmp_path / "candidates.json").write_text("{}")
    traces = readers.traces(spark, str(tmp_path))
    assert readers.trace_errors(traces).count() == 0
    got = {(r.trace, r.capture): r for r in ops.replayed(traces, ("unit-region",)).collect()}
    for t in families.generate({"a.py": source}, "a.py", 3, 5):
        for c in replay.run(t["files"], t["events"], "unit-region"):
            r = got[t["name"], c["capture"]]
            assert (r.method, r.recall, r.payload_sha256, r.repo, r.error) == (c["method"], c["recall"], c["payload_sha256"], "flask", None)


def test_ledgers_scans_and_results(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("\t".join(readers.LEDGER_COLUMNS) + "\n" + "\t".join(["t", "c", "p", "h", "0.5", "n/a", "0", "1", "502", "0.2", "n/a", "keep", "note"]) + "\n")
    row = readers.experiment_ledger(spark, str(tmp_path / "l.tsv")).first()
    assert (row.train_score, row.exact_current_rate, row.projection_bytes, row.decision) == (0.5, None, 502.0, "keep")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/002.scan.json").write_text(json.dumps({"n": 2, "utf8Bytes": 10, "promptTokens": None}, indent=1))
    assert [(r.file, r.n, r.utf8Bytes) for r in readers.scans(spark, str(tmp_path / "s")).collect()] == [("002.scan.json", 2, 10)]
    (tmp_path / "m.json").write_text(json.dumps({"repositories": [{"id": "a", "url": "u", "ref": "r"}]}))
    assert [(r.id, r.ref) for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", "r")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "name string, x double")
    writers.tsv(df, str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"a\t1.0", "b\tn/a", "name\tx"}
    writers.json_lines(df, str(tmp_path / "j"))
    writers.json_lines(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    lines = [r.line for r in writers.markdown_rows(df, ["name"], {"x": 2}).orderBy("place").collect()]
    assert lines == ["| name | x |", "|---|---|", "| a | 1.00 |", "| b | — |"]
    cells = readers.table_cells(spark.createDataFrame([(1, "\n".join(lines))], "k int, value string"), "k").filter("column = 'x'").orderBy("row")
    assert [r.value for r in cells.collect()] == ["1.00", "—"]
    with pytest.raises(ValueError):
        writers.guarded("x/results.jsonl")
    assert spark.range(1).select(readers.unsafe_path(F.lit("a/../b"))).first()[0]
