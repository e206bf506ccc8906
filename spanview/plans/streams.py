"""Streams that are stopped and go on: sessions of events whose units live in the state store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import request_stream
from ..streaming import units
from .sessions import _TRACKED
from .tables import reads, scratch, table

#: A session's reads up to these come in the first and the second part of the stream, the others in the third.
PARTS = (10, 30)


def _reloaded(spark, sf_dir) -> str:
    """A folder with the rows (out) and the checkpoint of a stream over events that was stopped after each of three parts."""
    base, r = scratch(spark, "reload"), reads(spark, sf_dir)
    schema, key = r.schema, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    units.store(spark)
    try:
        # The order of reads is worked out once for all parts; a folder is renamed when its part comes.
        r.withColumn("part", F.when(F.col("seq") <= PARTS[0], 0).when(F.col("seq") <= PARTS[1], 1).otherwise(2)).write.partitionBy("part").parquet(f"{base}/later")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = folder(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for i in range(len(PARTS) + 1):
            fs.mkdirs(folder(f"{base}/in/part={i}"))
            for file in fs.globStatus(folder(f"{base}/later/part={i}/*.parquet")):
                fs.rename(file.getPath(), folder(f"{base}/in/part={i}/{file.getPath().getName()}"))
            stream = spark.readStream.schema(schema).parquet(f"{base}/in/part=*")
            out = units.tracked_units(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return base


def stream_reload(spark, sf_dir):
    """Each read of a session with its unit's state after it, over three runs of one query."""
    out = spark.read.parquet(f"{_reloaded(spark, sf_dir)}/out")
    return out.select(F.col("session").cast("bigint").alias("session"), "seq", "unit_id", "revision", "change_count", "changed_at", "pinned")


def stream_saved_units(spark, sf_dir):
    """What those runs leave in the state store."""
    saved = units.saved_units(spark, f"{_reloaded(spark, sf_dir)}/checkpoint")
    return saved.select(F.col("session").cast("bigint").alias("session"), "unit_id", "revision", "turn", "change_count", "changed_at", "pinned")


def stream_requests(spark, sf_dir):
    """Turns as request objects in a spool, of which every seventh is cut off, taken by a stream in two runs."""
    c, base = table(spark, sf_dir, "conversations"), scratch(spark, "spool")
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    line = F.when(F.col("turn") % 7 == 6, F.substring(body, 1, 9)).otherwise(body)
    r = F.col("request")
    for i in range(2):
        c.filter(F.col("conv_id") % 2 == i).select(line.alias("value")).write.text(f"{base}/in/{i}")
        seen = request_stream.requests(request_stream.lines(spark, f"{base}/in")).select(
            F.try_variant_get(r, "$.id", "bigint").alias("id"), F.try_variant_get(r, "$.messages[0].role", "string").alias("role"), F.length(F.try_variant_get(r, "$.messages[0].content", "string")).cast("bigint").alias("chars"), "malformed"
        )
        seen.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


QUERIES = {"stream_reload": stream_reload, "stream_saved_units": stream_saved_units, "stream_requests": stream_requests}

ORACLE_SQL = {
    "stream_reload": f"WITH {_TRACKED} SELECT session, seq, unit_id, revision, change_count, changed_at, pin AS pinned FROM tracked",
    "stream_saved_units": f"WITH {_TRACKED} SELECT session, unit_id, revision, observed_at AS turn, change_count, changed_at, pinned FROM cur",
    "stream_requests": "SELECT CASE WHEN turn % 7 < 6 THEN conv_id END AS id, CASE WHEN turn % 7 < 6 THEN role END AS role, CASE WHEN turn % 7 < 6 THEN length(text) END AS chars, turn % 7 = 6 AS malformed FROM conversations",
}
