"""Sinks: JSON lines, TSV and Markdown reports, trace files. Writers are Spark's own, so they commit as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refused(path: Column) -> Column:
    """Whether a report must not go to a path: the recorded results, and what is sealed in a pack."""
    return F.endswith(path, F.lit("results.jsonl")) | F.contains(path, F.lit("/packs/")) & F.contains(path, F.lit("sealed"))


def guarded(path: str) -> str:
    """path, unless a report must not go there."""
    if path.endswith("results.jsonl") or "/packs/" in path and "sealed" in path:
        raise ValueError(f"reports may not be written to {path}")
    return path


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def tsv(df: DataFrame, path: str, missing: str = "n/a") -> None:
    """TSV with a header; nulls as they are written in ledgers."""
    df.write.mode("overwrite").option("nullValue", missing).csv(path, sep="\t", header=True)


def state(df: DataFrame, path: str) -> None:
    """Session state as a whole new version under path: written beside it and renamed when it is complete, so that readers see the old or the new one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = f"{path}/_new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    number = max((int(x.getPath().getName().split("-")[1]) for x in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version-*")) or ()), default=0) + 1
    if not files.rename(jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(f"{path}/version-{number:09d}")):
        raise OSError(f"could not commit {path}")


#: Names of events in files, where they differ.
_NAMES = {"start_line": "startLine", "end_line": "endLine", "budget": "budgetChars", "required": "requiredUnits"}


def trace_files(traces: DataFrame, path: str) -> None:
    """One JSON file a trace, in a folder of its own; fields as the format names them."""
    kind = traces.schema["events"].dataType.elementType
    event = F.transform("events", lambda e: F.struct(*(e[f.name].alias(_NAMES.get(f.name, f.name)) for f in kind.fields)))
    out = traces.select(
        F.lit(1).alias("schemaVersion"), "name", F.struct(F.col("repository").alias("repository")).alias("source"), F.col("files").alias("initialFiles"), event.alias("events"), F.sha2("name", 256).alias("trace"),
    )
    out.repartition("trace").write.mode("overwrite").partitionBy("trace").json(path)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def markdown_rows(df: DataFrame, order: list[str], digits: dict[str, int] | None = None) -> DataFrame:
    """(place, line): a Markdown table of a report, header first. Reports are aggregates with few rows."""
    digits = digits or {}
    cells = [fixed(F.col(c), digits[c]) if c in digits else F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in df.columns]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    body = df.select(F.struct(*order).alias("k"), line.alias("line"))
    ordered = body.agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("rows"))
    head = F.array(F.lit("| " + " | ".join(df.columns) + " |"), F.lit("|" + "---|" * len(df.columns)))
    return ordered.select(F.posexplode(F.concat(head, F.transform("rows", lambda r: r["line"]))).alias("place", "line"))
