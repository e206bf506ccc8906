"""Overlapping reads of files, regions and symbols: what they cover together, how often, and which of them would do.

Reads are spans of lines (first, last), both included, by session and path. Endpoints are swept in order: each stretch between
two of them has a depth, the number of reads over it. Stretches of a depth that touch make up the fewest spans that cover what
was read; a stretch of depth d shows its bytes d - 1 times too often.

Scale: endpoints are added up by place before anything is ordered, so a file that a third of all reads are of has at most two
rows a line, and its sweep is a window over that. Bytes come from the lines' offsets at the stretches' ends, not from the lines
between. The choice of reads streams through sorted partitions, and holds two numbers and a name.

Cases: spans that end before they begin, or with a null end, read nothing. Lines before the first and after the last of a file
have no bytes. Repeated reads count each. Null sessions and paths are values of their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_KEYS = ("session", "path")


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Whether keys are equal, null to null; b has them with a line before their names."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def stretches(reads: DataFrame) -> DataFrame:
    """(session, path, first, last, depth): the lines between two neighbouring endpoints of reads (session, path, first, last), where any read is."""
    ok = reads.filter("first <= last")
    ends = ok.select(*_KEYS, F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    summed = ends.select(*_KEYS, F.col("e.at").cast("bigint").alias("at"), F.col("e.step").alias("step")).groupBy(*_KEYS, "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*_KEYS).orderBy("at")
    depth = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = summed.select(*_KEYS, F.col("at").alias("first"), (F.lead("at").over(order) - 1).alias("last"), depth.alias("depth"))
    return out.filter("depth > 0")


def covered(reads: DataFrame) -> DataFrame:
    """(session, path, first, last): the fewest spans that cover what reads cover; spans that touch are one."""
    order = Window.partitionBy(*_KEYS).orderBy("first")
    parts = stretches(reads).select(*_KEYS, "first", "last")
    begins = F.coalesce(F.lag("last").over(order) + 1 < F.col("first"), F.lit(True)).cast("int")
    numbered = parts.withColumn("_new", begins).withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*_KEYS, "_span").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_span")


def line_offsets(files: DataFrame) -> DataFrame:
    """(path, line, upto): bytes of a file (path, content) up to the end of a line from 1, its line end included; line 0 has none."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    sizes = F.transform(lines, lambda x, i: (F.octet_length(x) + (i < F.size(lines) - 1).cast("int")).cast("bigint"))
    each = files.select("path", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), sizes)).alias("line", "size"))
    upto = F.sum("size").over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("path", "line", upto.alias("upto"))


def with_bytes(spans: DataFrame, files: DataFrame) -> DataFrame:
    """spans (path, first, last, ...) with bytes, what their lines have in files (path, content); 0 for paths that are not there."""
    offsets = line_offsets(files)
    size = files.select(F.col("path").alias("_path"), F.size(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("_n"))
    out = spans.join(size, F.col("path") == F.col("_path"), "left").drop("_path")
    for name, line in (("_from", F.greatest(F.col("first") - 1, F.lit(0))), ("_to", F.col("last"))):
        at = offsets.select(F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("upto").alias(name))
        out = out.withColumn("_at", F.least(line, F.col("_n"))).join(at, (F.col("path") == F.col("_path")) & (F.col("_at") == F.col("_line")), "left").drop("_path", "_line", "_at")
    return out.withColumn("bytes", F.coalesce(F.greatest(F.col("_to") - F.col("_from"), F.lit(0)), F.lit(0)).cast("bigint")).drop("_n", "_from", "_to")


def needed(reads: DataFrame) -> DataFrame:
    """(session, path, read_id): as few of reads (session, path, first, last, read_id) as cover what all cover; of equal ones the smaller read_id."""
    kinds = dict(reads.dtypes)
    ok = reads.filter("first <= last").select(*_KEYS, F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "read_id")
    # Of reads that begin at one line the longest is enough.
    longest = F.max("last").alias("last"), F.min(F.struct((-F.col("last")).alias("n"), "read_id"))["read_id"].alias("read_id")
    slim = ok.groupBy(*_KEYS, "first").agg(*longest)
    dealt = slim.select(*_KEYS, "first", "last", "read_id").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "first")

    def chosen(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, done, best = None, 0, None
        for session, path, first, last, read_id in rows:
            if key != (session, path):
                if best:
                    yield (*key, best[1])
                key, done, best = (session, path), first - 1, None
            if first > done + 1 and best:
                yield (*key, best[1])
                done, best = best[0], None
            if first > done + 1:
                done = first - 1
            if last > done and (best is None or last > best[0]):
                best = (last, read_id)
        if best:
            yield (*key, best[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, []

        def rows() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([batch.schema.field(k) for k in (*_KEYS, "read_id")])
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for row in chosen(rows()):
            held.append(row)
            if len(held) == 16_384:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return dealt.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in (*_KEYS, "read_id")))


def report(reads: DataFrame, files: DataFrame) -> DataFrame:
    """(session, path, reads, needed, spans, covered_bytes, repeated_bytes) of each session and path that is read."""
    n = reads.filter("first <= last").groupBy(*_KEYS).agg(F.count("*").alias("reads"))
    depth = with_bytes(stretches(reads), files).groupBy(*_KEYS).agg(F.sum("bytes").alias("covered_bytes"), F.sum(F.col("bytes") * (F.col("depth") - 1)).alias("repeated_bytes"))
    spans = covered(reads).groupBy(*_KEYS).agg(F.count("*").alias("spans"))
    few = needed(reads).groupBy(*_KEYS).agg(F.count("*").alias("needed"))
    out = n
    for part in (few, spans, depth):
        named = part.select(*(F.col(k).alias(f"_{k}") for k in _KEYS), *(c for c in part.columns if c not in _KEYS))
        out = out.join(named, _same(out, named, _KEYS), "left").drop(*(f"_{k}" for k in _KEYS))
    return out
