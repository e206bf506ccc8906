"""Stateful streams of sessions: tracked units, and deliveries in two phases.

State is keyed by session and kept in the state store, so a restarted query goes on from its
checkpoint, and a batch that is run again gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import engine
from ..relocation import Anchors

UNITS = "session string, seq bigint, unit_id string, path string, revision string, change_count bigint, changed_at bigint, state string, method string"
DELIVERIES = "session string, seq bigint, unit_id string, revision string, outcome string"


def _restored(text: str) -> engine.Session:
    saved = json.loads(text)
    session = engine.Session()
    session.turn = saved["turn"]
    for u in saved["units"]:
        unit = engine.Unit(**{**u, "anchors": Anchors(**u["anchors"])})
        session.units[unit.id] = unit
    return session


def _saved(session: engine.Session) -> str:
    return json.dumps({"turn": session.turn, "units": [asdict(u) for u in session.units.values()]})


def tracked(reads: DataFrame, idle: str | None = None) -> DataFrame:
    """Each read (session, seq, turn, path, scope, selector, start_line, end_line, content) with its unit's state after it.

    With idle, such as "6 hours", a session that is idle for longer loses its state. A query
    with it never runs out of batches, so it fits continuous triggers only.
    """
    milliseconds = {"hours": 3_600_000, "minutes": 60_000, "seconds": 1000}
    n, unit = idle.split() if idle else ("0", "seconds")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = _restored(state.get[0]) if state.exists else engine.Session()
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["turn", "seq"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            session.turn = max(session.turn, int(r.turn))
            last = None if pd.isna(r.end_line) else int(r.end_line)
            u = session.read(r.path, r.content, r.scope, 1 if pd.isna(r.start_line) else int(r.start_line), last, r.selector if isinstance(r.selector, str) else None)
            out.append((key[0], r.seq, u.id, u.path, u.revision, u.change_count, u.changed_at, u.state, u.method))
        state.update((_saved(session),))
        if idle:
            state.setTimeoutDuration(int(n) * milliseconds[unit])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in UNITS.split(", ")])

    return reads.groupBy("session").applyInPandasWithState(fold, UNITS, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def acknowledged(events: DataFrame) -> DataFrame:
    """Deliveries settled: pending ones (session, seq, kind, unit_id, revision) wait in state for the session's next event.

    sent or completed commits them, anything else discards them; one that was settled before is not settled again.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"last": -1, "pending": []}
        out = []
        for r in pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable").itertuples(index=False):
            if r.seq <= saved["last"]:
                continue
            saved["last"] = int(r.seq)
            if r.kind == "pending":
                saved["pending"].append([int(r.seq), r.unit_id, r.revision])
                continue
            outcome = "committed" if r.kind in ("sent", "completed") else "discarded"
            out += [(key[0], *p, outcome) for p in saved["pending"]]
            saved["pending"] = []
        state.update((json.dumps(saved),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DELIVERIES.split(", ")])

    return events.groupBy("session").applyInPandasWithState(fold, DELIVERIES, "saved string", "append", GroupStateTimeout.NoTimeout)


def windowed_activity(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events (ts, kind, value) by window and kind; rows later than the watermark are left out."""
    from pyspark.sql import functions as F

    out = events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "kind", "n", "total")
