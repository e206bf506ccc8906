"""Tracked units of sessions as a stream that can be stopped anywhere and goes on from its checkpoint.

State is a map from unit to its last revision and counters, by session, in the state store: a batch reads and writes the units
that it observes, whatever else the session has, and texts are not kept. A restarted query gives the rows that one without a
restart gives, and what it has in state is a table (saved_units).

The store is RocksDB's (store() sets it), which keeps maps and timers beside memory. With idle, a session that sees nothing for
so long is forgotten as a whole; its units then begin anew.

Cases: reads of one batch are taken in order of turn, then seq; a read that comes in a later batch counts as later. A read that
is not newer than its unit's last one repeats it: its row shows the unit as it is. Null sessions are a session of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import registry

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNIT = "path string, revision string, turn bigint, seq bigint, change_count bigint, changed_at bigint, pinned boolean"
_OUT = "session string, turn bigint, seq bigint, unit_id string, path string, revision string, change_count bigint, changed_at bigint, pinned boolean"
_ROW = Row(*(c.split()[0] for c in _OUT.split(", ")))


def store(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Units(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.units = handle.getMapState("units", "unit_id string", _UNIT)
        self.active = handle.getValueState("active", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802  the interface's names
        # The store is asked once a unit, not at all of a new session, and told once a unit: each call is a trip to the JVM.
        held: dict[str, tuple | None] = {}
        news: dict[str, tuple] = {}
        known = self.units.exists()
        for r in sorted(rows, key=lambda r: (r.turn, r.seq)):
            if r.unit_id not in held:
                held[r.unit_id] = self.units.getValue((r.unit_id,)) if known and self.units.containsKey((r.unit_id,)) else None
            last = held[r.unit_id]
            if last is None:
                now = (r.path, r.revision, r.turn, r.seq, 0, r.turn, bool(r.pinned))
            elif (r.turn, r.seq) <= (last[2], last[3]):
                now = tuple(last)
            else:
                changed = r.revision != last[1]
                now = (r.path, r.revision, r.turn, r.seq, last[4] + changed, max(last[5], r.turn) if changed else last[5], last[6] or bool(r.pinned))
            if last is None or now != tuple(last):
                held[r.unit_id] = news[r.unit_id] = now
            path, revision, _, _, change_count, changed_at, pinned = now
            yield _ROW(key[0], r.turn, r.seq, r.unit_id, path, revision, change_count, changed_at, pinned)
        for unit_id, now in news.items():
            self.units.updateValue((unit_id,), now)
        if self.idle_ms:
            at = timerValues.getCurrentProcessingTimeInMs()
            self.active.update((at,))
            self.handle.registerTimer(at + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        # Each batch sets a timer; the last one finds the session idle.
        if self.active.exists() and self.active.get()[0] + self.idle_ms <= timerValues.getCurrentProcessingTimeInMs():
            self.units.clear()
            self.active.clear()
        return iter(())

    def close(self) -> None:
        pass


def tracked_units(reads: DataFrame, idle: str | None = None) -> DataFrame:
    """Each read (session, turn, seq, path, scope, selector, start_line, end_line, content, pinned) with its unit's state after it.

    idle, such as "6 hours", forgets sessions that see nothing for so long.
    """
    n, unit = idle.split() if idle else ("0", "seconds")
    ms = int(n) * {"hours": 3_600_000, "minutes": 60_000, "seconds": 1000, "milliseconds": 1}[unit]
    slim = registry.identified(reads).select(
        F.col("session").cast("string").alias("session"), F.col("turn").cast("bigint").alias("turn"), F.col("seq").cast("bigint").alias("seq"), "unit_id", "path", "revision", F.coalesce("pinned", F.lit(False)).alias("pinned")
    )
    return slim.groupBy("session").transformWithState(_Units(ms), _OUT, "Append", "ProcessingTime" if idle else "None")


def saved_units(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, unit_id, path, revision, turn, seq, change_count, changed_at, pinned): what a query has in state, from its checkpoint, while it runs or not."""
    saved = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "units").load()
    return saved.select(F.col("key.session").alias("session"), F.col("user_map_key.unit_id").alias("unit_id"), "user_map_value.*")
