"""The driver's tables read as units, sessions, messages and facts.

documents are files of a workspace, one session a source; events are the reads and captures
of a session, one a user; conversations are transcripts; benchmark items are required texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, text
from ..shared import scratch as scratch

TASK, TURN, BUDGET = "review the context and restore the working state of this thing", 9, 12_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as file units; turns, pins and changes follow from doc_id."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    out = d.select(
        F.coalesce("source", F.lit("none")).alias("session"), path.alias("path"), F.lit("file").alias("scope"), F.lit(None).cast("string").alias("selector"), F.coalesce("text", F.lit("")).alias("content"),
        "doc_id", (F.col("doc_id") % 10).alias("last_used_at"), (F.col("doc_id") % 11).alias("changed_at"), (F.col("doc_id") % 3).alias("change_count"),
        (F.col("doc_id") % 97 == 0).alias("pinned"), F.when(F.col("doc_id") % 13 == 0, "unresolved").otherwise("resolved").alias("state"), F.lit("whole-file").alias("method"),
    )
    return out.withColumns({
        "start_line": F.lit(1), "end_line": text.line_count(F.col("content")), "unit_id": ids.unit_id(F.col("path"), F.col("scope"), F.lit(None).cast("string"), F.lit(1), text.line_count(F.col("content"))),
        "revision": ids.revision(F.col("content")),
    })


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reads of a session (user): the value names the path, its size the content."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return e.select(
        F.col("user_id").alias("session"), "event_id", F.col("event_type").alias("kind"), seq.cast("bigint").alias("seq"), F.col("value").alias("value"), k.alias("k"),
        F.concat(F.lit("src/f"), (k % 7).cast("string"), F.lit(".py")).alias("path"),
    ).withColumns({
        "turn": F.col("seq"), "scope": F.when(F.col("k") % 2 == 0, "file").otherwise("region"), "selector": F.lit(None).cast("string"), "start_line": F.lit(1),
        "end_line": F.when(F.col("k") % 2 == 0, F.lit(1)).otherwise((F.col("k") % 5 + 1).cast("int")), "content": F.concat(F.lit("v"), F.floor(F.coalesce("value", F.lit(0.0)) / 50).cast("string")),
        "pinned": F.col("k") == 11, "call_id": F.concat(F.lit("c"), F.col("event_id").cast("string")),
    })


#: The same in SQL.
UNITS_SQL = """
units AS (
  SELECT coalesce(source, 'none') AS session, coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content, doc_id,
         doc_id % 10 AS last_used_at, doc_id % 11 AS changed_at, doc_id % 3 AS change_count, doc_id % 97 = 0 AS pinned,
         CASE WHEN doc_id % 13 = 0 THEN 'unresolved' ELSE 'resolved' END AS state,
         len(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS end_line
  FROM documents),
named AS (
  SELECT *, 'fc_' || left(sha256(path || chr(0) || 'file' || chr(0) || '1:' || end_line), 16) AS unit_id, 'sha256:' || sha256(content) AS revision FROM units)
"""
READS_SQL = """
numbered AS (
  SELECT user_id AS session, event_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value,
         coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k
  FROM events),
reads AS (
  SELECT *, seq AS turn, 'src/f' || (k % 7) || '.py' AS path, CASE WHEN k % 2 = 0 THEN 'file' ELSE 'region' END AS scope, 1 AS start_line,
         CASE WHEN k % 2 = 0 THEN 1 ELSE k % 5 + 1 END AS end_line, 'v' || CAST(floor(coalesce(value, 0) / 50) AS BIGINT) AS content, k = 11 AS pinned, 'c' || event_id AS call_id
  FROM numbered),
identified AS (
  SELECT *, 'fc_' || left(sha256(path || chr(0) || scope || chr(0) || '1:' || end_line), 16) AS unit_id, 'sha256:' || sha256(content) AS revision FROM reads)
"""
