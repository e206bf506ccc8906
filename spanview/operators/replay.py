"""Replay of many traces through many systems, and the traces' own steps as relations.

A trace is one row with its files and events; traces are independent, and each is folded in order,
through all systems, where it is. Files whose traces are made and replayed at once are dealt out evenly first,
which moves each file once and its traces, many times as large, not at all; what all traces of a file begin
with is replayed once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import families, replay
from ..functions import text

EVENT = "struct<type:string,path:string,scope:string,start_line:int,end_line:int,selector:string,expected:string,replacement:string,task:string,budget:int,required:array<struct<path:string,selector:string,sha256:string>>>"
_EVENT_FIELDS = ("type", "path", "scope", "start_line", "end_line", "selector", "expected", "replacement", "task", "budget", "required")
TRACE = f"name string, repository string, files map<string,string>, events array<{EVENT}>"
_MEASURES = (
    "capture int, task string, method string, exact_rate double, recall double, stale_rate double, stale_units bigint, stale_bytes bigint, duplicate_units bigint, duplicate_bytes bigint,"
    " projection_bytes bigint, payload_bytes bigint, prefix_reuse double, required bigint, projected bigint, payload_sha256 string"
)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly over more tasks than there are cores: a table may be a few files that cannot be split, and a row costs its many runs."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _runs(groups: Iterator[Sequence[dict]], systems: tuple[str, ...], parser, hashed: bool = True, last: bool = False) -> Iterator[dict]:
    """Rows of traces, which come in groups that may begin alike; with last, of the last capture of each only."""
    for traces in groups:
        for r, out in zip(traces, replay.run_all(traces, systems, parser, hashed)):
            base = {"trace": r["name"], "repo": replay.repository(r["repository"], r["name"]), "family": replay.family(r["name"])}
            if isinstance(out, replay.TraceError):
                yield from ({**base, "system": name, "error": str(out)} for name in systems)
            else:
                yield from ({**base, "system": name, **m} for name, own in zip(systems, out) for m in (own[-1:] if last else own))


_MEASURED = f"trace string, repo string, family string, system string, {_MEASURES}, error string"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_FIELDS = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _MEASURED.split(", ")])


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of size, not in one of each input row: a batch costs about as much as a hundred rows."""
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    # Rows hold whole files; few at a time become Python objects.
    return (r for b in batches for i in range(0, b.num_rows, 16) for r in b.slice(i, 16).to_pylist())


def replayed(traces: DataFrame, systems: tuple[str, ...] = replay.SYSTEMS, parser=None) -> DataFrame:
    """Measures of every capture: (trace, repo, family, system, capture, ..., error). A trace that fails gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_runs(([r] for r in _rows(batches)), systems, parser), _FIELDS, 1024)

    return traces.select("name", "repository", "files", "events").mapInArrow(run, _MEASURED)


def replayed_files(files: DataFrame, make, systems: tuple[str, ...] = replay.SYSTEMS, parser=None, columns: Sequence[str] | None = None, last: bool = False) -> DataFrame:
    """As replayed, of the traces that make(name, path, content) gives of each file (name, path, content): a trace, which has its files several times over, is replayed where it is made.

    columns: those of the result, all by default; others do not leave Python, and payloads are hashed only if payload_sha256 is among them.
    last: all captures are replayed and measured, but of each trace and system only the last leaves Python.
    """
    fields = _FIELDS if columns is None else pa.schema([_FIELDS.field(c) for c in columns])
    kinds = dict(c.split() for c in _MEASURED.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (list(make(r["name"], r["path"], r["content"])) for r in _rows(batches) if r["content"] is not None)
        return _batches(_runs(made, systems, parser, "payload_sha256" in fields.names, last), fields, 1024)

    return _spread(files.select("name", "path", "content")).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in fields.names))


def _generated(files: DataFrame, make) -> DataFrame:
    """Traces that make(name, path, content) gives of each file (name, path, content)."""
    event = pa.struct([*((n, pa.string()) for n in ("type", "path", "scope")), ("start_line", pa.int32()), ("end_line", pa.int32()), *((n, pa.string()) for n in ("selector", "expected", "replacement", "task")),
                       ("budget", pa.int32()), ("required", pa.list_(pa.struct([(n, pa.string()) for n in ("path", "selector", "sha256")])))])
    schema = pa.schema([("name", pa.string()), ("repository", pa.string()), ("files", pa.map_(pa.string(), pa.string())), ("events", pa.list_(event))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (x for r in _rows(batches) if r["content"] is not None for x in make(r["name"], r["path"], r["content"]))
        return _batches(({**x, "files": list(x["files"].items())} for x in made), schema, 32)

    return files.select("name", "path", "content").mapInArrow(run, TRACE)


def region_traces(first: int, last: int):
    """What makes the traces of lines first to last of a file: one of each family that the region admits, named after the file. A file too short for the region has none."""
    return lambda name, path, content: families.generate({path: content}, path, first, last, name) if content.count("\n") + 1 >= last else []


def symbols_traces(name: str, path: str, content: str) -> list[dict]:
    return families.symbol_traces(path, content, name)


def generated(files: DataFrame, first: int, last: int) -> DataFrame:
    """Traces of lines first to last of each file (name, path, content): one of each family that the region admits, named after the file.

    Files that are null or too short for the region have none.
    """
    return _generated(files, region_traces(first, last))


def symbol_traces(files: DataFrame) -> DataFrame:
    """Traces of the symbols of Python files (name, path, content)."""
    return _generated(files, symbols_traces)


def events_of(traces: DataFrame) -> DataFrame:
    """(trace, seq, ...) of all events."""
    return traces.select(F.col("name").alias("trace"), F.posexplode("events").alias("seq", "e")).select("trace", "seq", "e.*")


def files_of(traces: DataFrame) -> DataFrame:
    return traces.select(F.col("name").alias("trace"), F.explode("files").alias("path", "content"))


def replaced_first(content: Column, expected: Column, replacement: Column) -> Column:
    """content with the first place of expected replaced, null where there is none."""
    at = F.call_function("instr", content, expected)
    before = F.substring(content, F.lit(1), at - 1)
    after = F.substring(content, at + F.length(expected), F.length(content))
    return F.when(at > 0, F.concat(before, replacement, after))


def gold(content: Column, scope: Column, start: Column, end: Column, initial: Column) -> Column:
    """Current text of a read, as replay.current_text has it; empty for a missing file."""
    own = F.split(content, "\n", -1)
    anchor = F.get(F.split(initial, "\n", -1), F.lit(0))
    by_line = text.line_slice(content, start, end)
    places = F.filter(F.transform(own, lambda x, i: F.when(x == anchor, i)), lambda i: i.isNotNull())
    moved = F.array_join(F.slice(own, F.get(places, F.lit(0)) + 1, end - start + 1), "\n")
    stays = F.get(F.split(by_line, "\n", -1), F.lit(0)) == anchor
    return F.when(content.isNull(), "").when(scope == "file", content).when(stays | (F.size(places) != 1), by_line).otherwise(moved)


def baseline_payloads(reads: DataFrame, captures: DataFrame, files: DataFrame) -> DataFrame:
    """(trace, system, payload) of the systems without state, for one capture a trace.

    reads: (trace, seq, path, content); captures: (trace, task); files: (trace, path, content) now.
    """
    shown = reads.groupBy("trace").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.col("content").alias("t")))).alias("raw"),
        F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("[observation-mask:"), "path", F.lit("] An earlier read stood here; this system shows no text instead.")).alias("t")))).alias("mask"),
        F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("sync: "), "path").alias("t")))).alias("sync"),
    )
    synced = reads.select("trace", "path").distinct().join(files, ["trace", "path"]).groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("path", F.concat(F.lit('[whole-file path="'), "path", F.lit('"]\n'), "content").alias("t")))).alias("now"))
    rows = captures.join(shown, "trace").join(synced, "trace", "left")
    task = F.array(F.concat(F.lit("TASK: "), F.col("task")))

    def texts(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])), lambda x: x["t"])

    parts = {"append-only": F.concat(texts("raw"), task), "observation-mask": F.concat(texts("mask"), task), "whole-file": F.concat(texts("sync"), task, texts("now"))}
    each = F.array(*(F.struct(F.lit(k).alias("system"), F.array_join(v, "\n\n").alias("payload")) for k, v in parts.items()))
    return rows.select("trace", F.inline(each))


def reread_payloads(reads: DataFrame, captures: DataFrame, files: DataFrame) -> DataFrame:
    """(trace, payload) of the system that only appends, and reads every file it knows again before a request: its history, what those files say now in order of first reading, and the task.

    reads: (trace, seq, path, content); captures: (trace, task); files: (trace, path, content) now. A file that is gone adds nothing.
    """
    known = reads.groupBy("trace", "path").agg(F.min("seq").alias("seq"))
    again = known.join(files, ["trace", "path"]).select("trace", F.lit(1).alias("part"), "seq", "content")
    shown = reads.select("trace", F.lit(0).alias("part"), "seq", "content").unionByName(again)
    texts = shown.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "content"))).alias("texts"))
    parts = F.concat(F.transform("texts", lambda x: x["content"]), F.array(F.concat(F.lit("TASK: "), F.col("task"))))
    return captures.join(texts, "trace").select("trace", F.array_join(parts, "\n\n").alias("payload"))


def required_gold(required: DataFrame, reads: DataFrame, files: DataFrame) -> DataFrame:
    """required (trace, path, selector, sha256) with the gold text that the files give, scope, and error: missing, mismatch or null.

    reads: (trace, seq, path, selector, scope, start_line, end_line, initial); files: (trace, path, content) now. A unit is what the
    first read of its path read, of its selector if it names one; without such a read it is the whole file. Text that is not
    there or empty is missing; a text of another hash than the trace declares is a mismatch.
    """
    facts = F.struct("seq", "scope", "start_line", "end_line", "initial")
    by_name = reads.filter(F.col("selector").isNotNull()).groupBy("trace", "path", "selector").agg(F.min_by(facts, "seq").alias("_named"))
    by_path = reads.groupBy("trace", "path").agg(F.min_by(facts, "seq").alias("_any"))
    rows = required.join(by_name, ["trace", "path", "selector"], "left").join(by_path, ["trace", "path"], "left").join(files.select("trace", "path", F.col("content").alias("_now")), ["trace", "path"], "left")
    read = F.when(F.col("selector").isNull(), F.col("_any")).otherwise(F.col("_named"))
    rows = rows.withColumn("_read", read)
    of_read = gold(F.col("_now"), F.col("_read.scope"), F.col("_read.start_line"), F.col("_read.end_line"), F.col("_read.initial"))
    rows = rows.withColumns({"gold": F.when(F.col("_read").isNotNull(), of_read).otherwise(F.col("_now")), "scope": F.coalesce("_read.scope", F.lit("file"))})
    error = F.when(F.coalesce(F.length("gold"), F.lit(0)) == 0, "missing").when(~F.sha2("gold", 256).eqNullSafe(F.col("sha256")), "mismatch")
    return rows.select("trace", "path", "selector", "sha256", "scope", "gold", error.alias("error"))


def quarantined(golds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of traces all of whose units agree with their declarations, (trace, errors, paths) of the others): a trace whose gold is in doubt counts nowhere."""
    bad = golds.filter("error IS NOT NULL").groupBy("trace").agg(F.array_sort(F.collect_set("error")).alias("errors"), F.countDistinct("path").alias("paths"))
    return golds.join(bad, "trace", "left_anti"), bad


def event(kind: str, **values) -> dict:
    """An event of a trace."""
    return dict.fromkeys(_EVENT_FIELDS) | {"type": kind, **values}


def _load(fillers: int, lines: int) -> dict[str, str]:
    return {f"extra/load-{i}.txt": "".join(f"load {i}, line {n}\n" for n in range(lines)) for i in range(1, fillers + 1)}


def pressed(make, budget: int = 4_000, fillers: int = 4, lines: int = 120):
    """make, with its traces under_pressure."""
    extra = _load(fillers, lines)
    first = [event("read", path=path, scope="file") for path in extra]

    def under(trace: dict) -> dict:
        events = [{**e, "budget": budget} if e["type"] == "capture-request" else e for e in trace["events"]]
        return {**trace, "files": {**trace["files"], **extra}, "events": [*first, *events]}

    return lambda *file: map(under, make(*file))


def under_pressure(traces: DataFrame, budget: int = 4_000, fillers: int = 4, lines: int = 120) -> DataFrame:
    """traces with filler files read first and the budget of each capture overridden."""
    names, texts = zip(*_load(fillers, lines).items()) if fillers else ((), ())
    extra = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, texts)))

    def event(path: str) -> Column:
        values = {"type": F.lit("read"), "path": F.lit(path), "scope": F.lit("file")}
        fields = [f.split(":", 1) for f in ("type:string", "path:string", "scope:string", "start_line:int", "end_line:int", "selector:string", "expected:string", "replacement:string", "task:string", "budget:int", "required:array<struct<path:string,selector:string,sha256:string>>")]
        return F.struct(*(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))

    capped = F.transform("events", lambda e: F.when(e["type"] == "capture-request", e.withField("budget", F.lit(budget))).otherwise(e))
    return traces.withColumns({"files": F.map_concat("files", extra), "events": F.concat(F.array(*map(event, names)), capped)})
