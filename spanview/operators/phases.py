"""Phases over tables, of which each runs only on what the ones before it left, byte for byte.

A phase names its inputs: sources, or earlier phases. When it runs, its inputs are hashed in the very pass that reads them and
its output in the pass that writes it (DataFrame.observe), and the record keeps these hashes. Later runs compare: where all
inputs are as recorded the phase is kept and nothing is computed; where one is not, the phase is blocked, and so is what follows
from it. So what was frozen once cannot be replaced unseen; forget() lets a phase run anew.

A hash is of rows and not of their order: their number and two sums of hashes over all columns, so it is added up map-side and
is one row whatever the table's size. Sources are hashed once a run, by a scan.

Cases: an empty table has a hash. Columns of maps are hashed as JSON. A phase that fails leaves no record and blocks what
follows. Output that was written for an input that then turned out to be another is left out of the record. Rows with nulls
count; a null and a missing column differ by the number of columns.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..sources import readers, writers

COMPUTED, KEPT, BLOCKED = "computed", "kept", "blocked"
_RECORD = "phase string, inputs map<string,string>, hash string, rows bigint, location string"
_REPORT = "place int, phase string, state string, reason string, rows bigint, hash string"


@dataclass(frozen=True)
class Phase:
    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]


def _sums(df: DataFrame) -> list[Column]:
    cols = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema.fields] or [F.lit(1)]
    nulls = [c.isNull() for c in cols]
    wide = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), wide(F.xxhash64(F.lit(len(cols)), *cols, *nulls)).alias("a"), wide(F.hash(*cols, *nulls, F.lit(len(cols)))).alias("b")]


def _text(found: Mapping) -> str:
    return f"{found['rows']}:{found['a']}:{found['b']}"


def fingerprint(df: DataFrame) -> str:
    """The hash of a table, by a pass of its own."""
    return _text(df.agg(*_sums(df)).first().asDict())


def _seen(observation: Observation, seconds: float = 2.0) -> Mapping | None:
    """What a pass has seen; None where its plan could do without the observed table, as for an empty join."""
    until = time.time() + seconds
    while time.time() < until:
        row = observation._jo.getRowOrEmpty()
        if row.isDefined():
            return observation.get if row.get().length() else None
    return None


def _record(spark: SparkSession, path: str, name: str):
    try:
        return readers.latest_state(spark, f"{path}/{name}/record").first()
    except ValueError:  # there is no version yet
        return None


def output(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What a phase left."""
    found = _record(spark, path, name)
    if not found or not found.location:
        raise ValueError(f"phase {name} has not run")
    return spark.read.parquet(found.location)


def forget(spark: SparkSession, path: str, names: Iterable[str]) -> None:
    """Let phases run anew, and what follows from them if they then leave something else."""
    for name in names:
        writers.state(spark.createDataFrame([(name, {}, None, None, None)], _RECORD).coalesce(1), f"{path}/{name}/record")


def run(spark: SparkSession, phases: Iterable[Phase], sources: Mapping[str, DataFrame], path: str) -> DataFrame:
    """(place, phase, state, reason, rows, hash): the phases in order, each computed, kept or blocked; records and outputs are under path."""
    now = {name: fingerprint(df) for name, df in sources.items()}
    report, blocked = [], {}
    for place, phase in enumerate(phases):
        was = _record(spark, path, phase.name)
        was = was if was and was.location else None
        unknown = [i for i in phase.inputs if i not in now and i not in blocked]
        if unknown:
            raise ValueError(f"phase {phase.name} reads {', '.join(unknown)}, which nothing gives")
        after = [i for i in phase.inputs if i in blocked]
        changed = [i for i in phase.inputs if was and i in now and was.inputs.get(i) != now[i]]
        if after or changed:
            blocked[phase.name] = f"after {after[0]}" if after else f"{changed[0]} changed"
            report.append((place, phase.name, BLOCKED, blocked[phase.name], None, None))
            continue
        if was:
            now[phase.name] = was.hash
            report.append((place, phase.name, KEPT, None, was.rows, was.hash))
            continue
        seen = {i: Observation() for i in phase.inputs}
        given = {i: sources[i] if i in sources else output(spark, path, i) for i in phase.inputs}
        made = phase.make(*(df.observe(seen[i], *_sums(df)) for i, df in given.items()))
        written, location = Observation(), f"{path}/{phase.name}/out-{uuid.uuid4().hex}"
        made.observe(written, *_sums(made)).write.parquet(location)
        # A table that the pass did without is hashed by itself.
        other = [i for i in phase.inputs if (_text(got) if (got := _seen(seen[i])) else fingerprint(given[i])) != now[i]]
        if other:
            blocked[phase.name] = f"{other[0]} changed while it was read"
            report.append((place, phase.name, BLOCKED, blocked[phase.name], None, None))
            continue
        got = _seen(written)
        now[phase.name] = _text(got) if got else fingerprint(spark.read.parquet(location))
        n = int(now[phase.name].split(":")[0])
        record = (phase.name, {i: now[i] for i in phase.inputs}, now[phase.name], n, location)
        writers.state(spark.createDataFrame([record], _RECORD).coalesce(1), f"{path}/{phase.name}/record")
        report.append((place, phase.name, COMPUTED, None, n, now[phase.name]))
    return spark.createDataFrame(report, _REPORT)
