"""Observations to tracked units: versions, changes, recovery and the active set.

Reads are rows (session, seq, turn, path, scope, selector, start_line, end_line, content,
pinned). Everything that a batch can derive without the selection's feedback is a window
over (session, unit) in reading order, so a session's units spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, text


def identified(reads: DataFrame) -> DataFrame:
    """reads with normal text and path, end_line, unit_id and revision."""
    out = reads.withColumns({"path": ids.normal_path(F.col("path")), "content": text.unix_lines(F.col("content"))})
    out = out.withColumn("end_line", F.coalesce("end_line", F.col("start_line") + text.line_count(F.col("content")) - 1))
    return out.withColumns({
        "unit_id": ids.unit_id(*(F.col(c) for c in ("path", "scope", "selector", "start_line", "end_line"))),
        "revision": ids.revision(F.col("content")),
    })


def tracked(reads: DataFrame) -> DataFrame:
    """Each read with its unit's state after it: change_count, changed_at and pinned so far.

    The first read of a unit sets changed_at without counting as a change; later ones change
    it where the revision differs from that of the read before.
    """
    order = Window.partitionBy("session", "unit_id").orderBy("turn", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("revision").over(order)
    changed = before.isNotNull() & (before != F.col("revision"))
    out = identified(reads).withColumns({"changed": changed, "first": before.isNull()})
    return out.withColumns({
        "change_count": F.sum(F.col("changed").cast("bigint")).over(so_far),
        "changed_at": F.max(F.when(F.col("changed") | F.col("first"), F.col("turn"))).over(so_far),
        "pinned": F.max(F.coalesce("pinned", F.lit(False))).over(so_far),
    })


def current_units(reads: DataFrame) -> DataFrame:
    """The last state of each unit."""
    last = F.max_by(F.struct("path", "scope", "selector", "content", "revision", "start_line", "end_line", F.col("turn").alias("observed_at"), "change_count", "changed_at", "pinned"), F.struct("turn", "seq"))
    return tracked(reads).groupBy("session", "unit_id").agg(last.alias("u")).select("session", "unit_id", "u.*")


def versions(reads: DataFrame) -> DataFrame:
    """One row for each revision of a unit, as observed last."""
    last = F.max_by(F.struct("content", "start_line", "end_line", F.col("turn").alias("observed_at")), F.struct("turn", "seq"))
    return identified(reads).groupBy("session", "unit_id", "revision").agg(last.alias("v")).select("session", "unit_id", "revision", "v.*")


def recovered(wanted: DataFrame, units: DataFrame, archive: DataFrame) -> DataFrame:
    """(session, unit_id, revision?) to versions; no revision means the current one; unknown ones give no row."""
    now = wanted.join(units.select("session", "unit_id", F.col("revision").alias("_now")), ["session", "unit_id"])
    return now.withColumn("revision", F.coalesce("revision", "_now")).drop("_now").join(archive, ["session", "unit_id", "revision"])


def marked_used(units: DataFrame, used: DataFrame) -> DataFrame:
    """units with last_used_at raised to the turn of the latest use."""
    latest = used.groupBy("session", "unit_id").agg(F.max("turn").alias("_turn"))
    return units.join(latest, ["session", "unit_id"], "left").withColumn("last_used_at", F.coalesce("_turn", "last_used_at")).drop("_turn")


def active(units: DataFrame, calls: DataFrame) -> DataFrame:
    """units that an active call refers to."""
    return units.join(calls.filter("active"), ["session", "unit_id"], "left_semi")


def latest_by_observation(reads: DataFrame) -> DataFrame:
    """The last call of each observation key; reads without a key drop out."""
    key = ids.observation_key(*(F.col(c) for c in ("path", "scope", "selector", "start_line", "end_line")))
    keyed = reads.withColumn("observation", key).filter(F.col("observation").isNotNull())
    return keyed.groupBy("session", "observation").agg(F.max_by("call_id", "seq").alias("call_id"))


def files_as_of(events: DataFrame, captures: DataFrame) -> DataFrame:
    """Each capture with the last content of each path written up to its seq; deleted ones as null.

    events: (session, path, seq, content, deleted). captures: (session, capture, seq). An as-of
    join as one union and one window over (session, path): captures are dealt to a session's
    paths, so the rows are captures times paths of a session, as the result is.
    """
    paths = events.select("session", "path").distinct()
    asked = captures.join(paths, "session").select("session", "path", "seq", "capture", F.lit(None).cast("string").alias("content"), F.lit(None).cast("boolean").alias("deleted"))
    both = events.select("session", "path", "seq", F.lit(None).cast(dict(captures.dtypes)["capture"]).alias("capture"), "content", "deleted").unionByName(asked)
    # Writes come before a capture of the same seq.
    order = Window.partitionBy("session", "path").orderBy("seq", F.col("capture").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("deleted").isNotNull(), F.struct("content", "deleted")), ignorenulls=True).over(order)
    out = both.withColumn("_seen", seen).filter(F.col("capture").isNotNull() & F.col("_seen").isNotNull())
    return out.select("session", "capture", "path", F.when(~F.col("_seen.deleted"), F.col("_seen.content")).alias("content"))
