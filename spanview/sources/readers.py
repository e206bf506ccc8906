"""Sources: workspaces, trace packs, scans, ledgers, tables in Markdown, recorded values, event streams.

All are Spark readers with given schemas, so files are listed once, split and read by the
executors, from any file system that Spark reaches.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ids import normal_path
from ..operators.provenance import path_class

LIVE_LIMIT, BODY_LIMIT = 512 * 1024, 16 * 1024 * 1024

#: Records as they lie in files; names are part of the format.
TRACE_SCHEMA = (
    "schemaVersion int, name string, source struct<repository:string,commit:string,license:string>, initialFiles map<string,string>,"
    " events array<struct<type:string,path:string,scope:string,startLine:int,endLine:int,selector:string,expected:string,replacement:string,task:string,budgetChars:int,"
    "requiredUnits:array<struct<path:string,selector:string,sha256:string>>>>"
)
LAB_SCHEMA = "cell string, trace string, method string, payloadSha256 string, implementationCommitSha string, recall double, exact double, stale double, duplicate bigint, staleBytes bigint, projectionBytes bigint"
SYMBOL_SCHEMA = (
    "schemaVersion int, packId string, system string, repo string, path string, selector string, observationScope string, granularity string, goldSource string, verdict string, reason string,"
    " engineSpawn string, payloadSha256 string, goldSha256 string, failOpen boolean, goldInPayload boolean, payloadBytes bigint, peakRssBytes bigint,"
    " latencyMs struct<n:int,warmups:int,repetitions:int,min:double,p50:double,p95:double,p99:double,max:double>"
)
SCAN_SCHEMA = "n int, cellId string, utf8Bytes bigint, promptTokens bigint, completionTokens bigint, usageFrom string, dumpOnly boolean, host string, arm string, model string, source string"
CAPTURE_SCHEMA = "schema_version int, sequence int, method string, path string, content_type string, raw_bytes bigint, raw_sha256 string, canonical_bytes bigint, canonical_sha256 string, request string"
LEDGER_COLUMNS = ("timestamp", "commit", "paper_manifest", "hypothesis", "train_score", "exact_current_rate", "stale_unit_rate", "required_recall", "projection_bytes", "cache_prefix_reuse", "transform_p95_ms", "decision", "notes")
REPOS_SCHEMA = "id string, url string, ref string, language string, license string, tier string, why string"


def _relative(root: str) -> Column:
    """Path of a file below root, whatever the scheme."""
    path = F.col("_metadata.file_path")
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), f"^.*?{root.rstrip('/').split('://')[-1].replace('.', '[.]')}/", "")


def unsafe_path(path: Column) -> Column:
    """Whether a path is absolute or leaves its root."""
    return F.startswith(path, F.lit("/")) | path.rlike(r"^[A-Za-z]:") | F.arrays_overlap(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), F.array(F.lit("..")))


def _in_place(root: str, links: str) -> Column:
    """Whether a file is where its path says (refuse), or at least under root (contain). Asked where the file is read, as only its machine sees its links."""

    def local(uri: str) -> str:
        return unquote(urlsplit(uri).path) if uri.startswith("file:") else uri

    @F.pandas_udf("boolean")
    def asked(uris: pd.Series) -> pd.Series:
        top = os.path.realpath(local(root))

        def ok(uri: str) -> bool:
            path = local(uri)
            real = os.path.realpath(path)
            if links == "refuse":
                return real == os.path.join(top, os.path.relpath(path, os.path.abspath(local(root))))
            return os.path.commonpath([real, top]) == top

        return uris.map(ok)

    return asked(F.col("_metadata.file_path"))


def workspace(spark: SparkSession, root: str, limit: int | None = None, links: str = "refuse") -> DataFrame:
    """(path, content) of the text files under root, with LF line ends. With a limit in bytes, larger files and those with NUL are left out.

    links: refuse leaves out what is reached through a symbolic link, contain what such a link leads out of root; follow takes
    all. Only file systems of machines have such links; other stores are read as they are.
    """
    if links not in ("refuse", "contain", "follow"):
        raise ValueError(f"links must be refuse, contain or follow, not {links}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if links != "follow" and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
        files = files.filter(_in_place(root, links))
    files = files.filter(F.col("length") <= limit) if limit else files
    out = files.select(_relative(root).alias("path"), text.unix_lines(F.decode("content", "UTF-8")).alias("content"))
    return out.filter(~F.contains("content", F.lit("\0"))) if limit else out


def live_files(spark: SparkSession, root: str) -> DataFrame:
    """Files that a live session may read: small ones that really are under root."""
    return workspace(spark, root, LIVE_LIMIT, "contain")


def source_walk(spark: SparkSession, root: str) -> DataFrame:
    """workspace files with the reason why each is no candidate, null for sources."""
    return workspace(spark, root).withColumn("reason", path_class(F.col("path")))


def looked_up(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted paths with their content; a missing file is null."""
    named = files.select(normal_path(F.col("path")).alias("_path"), "content")
    return wanted.join(named, normal_path(wanted["path"]) == F.col("_path"), "left").drop("_path")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces (name, repository, files, events) of a pack; files of candidate lists are left out."""
    raw = spark.read.schema(TRACE_SCHEMA).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    raw = raw.filter(~F.startswith(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("candidates")) & F.col("events").isNotNull())
    event = F.transform("events", lambda e: F.struct(
        e["type"].alias("type"), e["path"].alias("path"), e["scope"].alias("scope"), e["startLine"].alias("start_line"), e["endLine"].alias("end_line"), e["selector"].alias("selector"),
        e["expected"].alias("expected"), e["replacement"].alias("replacement"), e["task"].alias("task"), e["budgetChars"].alias("budget"), e["requiredUnits"].alias("required"),
    ))
    return raw.select("name", F.col("source.repository").alias("repository"), F.col("initialFiles").alias("files"), event.alias("events"))


def trace_errors(raw: DataFrame) -> DataFrame:
    """(name, errors) of traces as read that break the format."""
    bad = F.filter("events", lambda e: ~e["type"].isin("read", "replace-exact", "delete-file", "capture-request") | (e["type"] != "capture-request") & e["path"].isNull())
    errors = F.array_compact(F.array(F.when(F.col("name").isNull(), "name"), F.when(F.size("events") == 0, "events"), F.when(F.size(bad) > 0, "event"), F.when(F.size("files") == 0, "files")))
    return raw.select("name", errors.alias("errors")).filter(F.size("errors") > 0)


def results(spark: SparkSession, path: str, schema: str = LAB_SCHEMA) -> DataFrame:
    """Result records of JSON lines."""
    return spark.read.schema(schema).json(path)


def scans(spark: SparkSession, path: str) -> DataFrame:
    """Request scans with their file's name, which orders them."""
    raw = spark.read.schema(SCAN_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.scan.json").json(path)
    return raw.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured requests; larger ones than the limit are left out."""
    return spark.read.schema(CAPTURE_SCHEMA).json(path).filter(F.coalesce("raw_bytes", F.lit(0)) <= BODY_LIMIT)


def requests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Request objects, one a file or one a line, as variants; null where it is no JSON."""
    return spark.read.text(path, wholetext=not lines).select(F.try_parse_json("value").alias("request"))


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a session state; unfinished ones are not seen."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or ()
    return spark.read.parquet(max(x.getPath().toString() for x in found))


def experiment_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Experiments of a TSV file; numbers that aren't there are null."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{c} string" for c in LEDGER_COLUMNS))
    numbers = LEDGER_COLUMNS[4:11]
    return raw.select(*(F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in LEDGER_COLUMNS))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a corpus manifest."""
    return spark.read.schema(f"repositories array<struct<{', '.join(REPOS_SCHEMA.split(', ')).replace(' string', ':string')}>>").option("multiLine", "true").json(path).select(F.inline("repositories"))


def markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, column, value) of the tables in Markdown files: each cell under its header."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return table_cells(files, "file")


def table_cells(texts: DataFrame, key: str) -> DataFrame:
    """Cells of the first table in each text (key, value)."""

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))

    rows = F.filter(F.split("value", "\n", -1), lambda x: F.startswith(F.trim(x), F.lit("|")))
    kept = F.filter(rows, lambda x: ~x.rlike(r"^\s*\|[\s|:-]+\|?\s*$"))
    body = texts.select(key, F.transform(kept, cells).alias("rows")).filter(F.size("rows") > 1)
    each = body.select(key, F.get("rows", F.lit(0)).alias("head"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row", "cells"))
    return each.select(key, "row", F.posexplode("head").alias("i", "column"), "cells").select(key, "row", "column", F.get("cells", F.col("i")).alias("value"))


def recorded_verdict(log: Column) -> Column:
    """JSON after the marker in a log, as text."""
    return F.when(log.rlike("EVALUATE_VERDICT="), F.regexp_extract(log, r"EVALUATE_VERDICT=(\{[^\n]*\})", 1))


def target(packs: DataFrame, wanted: str | None = None, fallback: str = "smoke") -> DataFrame:
    """(pack): the wanted one, else the last by name that is of the top level, else the fallback."""
    if wanted:
        return packs.sparkSession.range(1).select(F.lit(wanted).alias("pack"))
    return packs.agg(F.coalesce(F.max(F.when(F.col("pack").rlike("apex|level-4|level4"), F.col("pack"))), F.lit(fallback)).alias("pack"))
