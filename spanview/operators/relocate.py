"""Relocation of tracked regions in the current text of their files.

relocated() is the whole decision: units and files meet in one join, and each row is
decided on its own. The steps are relations as well, for plans that need only one of them:
exact places, boundary pairs with their ties, and the vote of unique lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Unit, resolve
from ..functions import text
from ..relocation import LEAST_VOTES, Anchors

#: Rows that are Python objects at once.
SLICE = 64


def anchors(content: Column, start_line: Column) -> Column:
    """struct(first, last, line_count, start_line) of a region."""
    full = F.filter(text.normal_lines(content), lambda x: x != "")
    return F.struct(
        F.coalesce(F.get(full, F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.element_at(F.when(F.size(full) > 0, full), -1), F.lit("")).alias("last"),
        text.line_count(content).alias("line_count"), start_line.alias("start_line"),
    )


def exact(units: DataFrame) -> DataFrame:
    """units (content, current, start_line) with places, and exact_start where there is just one."""
    current = text.unix_lines(F.col("current"))
    at = F.expr(r"locate(content, replace(current, '\r\n', '\n'))")
    n = text.occurrences(current, F.col("content"))
    return units.withColumn("places", n).withColumn("exact_start", F.when(n == 1, text.line_of_offset(current, at)))


def boundary_pairs(units: DataFrame, key: list[str]) -> DataFrame:
    """The best pairs of boundary lines: (key, start_at, end_at, span_delta, distance, rank, tied).

    units has key, current and anchors. A unit and its file are one row, so that pairs are made
    and ranked there, without a shuffle. For each start only the ends next to the expected one
    can rank among the two best: the latest at or before it and the earliest after it. They
    come from a search in a text of one letter a line, so a line as common as a closing brace
    makes no product of starts and ends.
    """
    a = F.col("anchors")
    rows = units.select(*key, a.alias("_a"), text.normal_lines(F.col("current")).alias("_c"))
    rows = rows.filter((F.col("_a.first") != "") & (F.col("_a.last") != ""))
    rows = rows.withColumn("_e", F.array_join(F.transform("_c", lambda x: F.when(x == F.col("_a.last"), "e").otherwise(".")), ""))
    rows = rows.withColumns({"_back": F.reverse("_e"), "_n": F.length("_e"), "_was": F.col("_a.start_line"), "_lines": F.col("_a.line_count"), "_first": F.col("_a.first")})
    starts = F.filter(F.transform("_c", lambda x, i: F.when(x == F.col("_first"), i)), lambda i: i.isNotNull())

    def pair(s: Column, e: Column) -> Column:
        return F.struct(F.abs(e - s + 1 - F.col("_lines")).alias("span_delta"), F.abs(s + 1 - F.col("_was")).alias("distance"), s.alias("start_at"), e.alias("end_at"))

    def pairs_of(s: Column) -> Column:
        expected = F.least(s + F.col("_lines") - 1, F.col("_n") - 1)
        before = F.col("_n") - F.call_function("locate", F.lit("e"), F.col("_back"), F.col("_n") - expected)
        after = F.call_function("locate", F.lit("e"), F.col("_e"), expected + 2) - 1
        near = F.array(F.when(before < F.col("_n"), before), F.when(after >= 0, after))
        return F.transform(F.filter(near, lambda e: e >= s), lambda e: pair(s, e))

    rows = rows.withColumn("_pairs", F.array_sort(F.flatten(F.transform(starts, pairs_of))))

    def alike(p: Column, other: Column) -> Column:
        return F.coalesce((p["span_delta"] == other["span_delta"]) & (p["distance"] == other["distance"]), F.lit(False))

    ties = F.transform("_pairs", lambda p, i: F.struct(p.alias("p"), (alike(p, F.get("_pairs", i - 1)) | alike(p, F.get("_pairs", i + 1))).alias("tied")))
    out = rows.select(*key, F.posexplode(ties).alias("_i", "_p"))
    return out.select(*key, "_p.p.start_at", "_p.p.end_at", "_p.p.span_delta", "_p.p.distance", (F.col("_i") + 1).alias("rank"), "_p.tied")


def consensus_votes(units: DataFrame, key: list[str]) -> DataFrame:
    """(key, start_at, support, interior, rank): where the region's lines that are unique in the file place its start.

    A unit and its file are one row, so that votes are counted there, without a shuffle.
    """
    rows = units.select(*key, text.normal_lines(F.col("content")).alias("_r"), text.normal_lines(F.col("current")).alias("_c"), F.col("anchors.line_count").alias("_n"), F.col("anchors.start_line").alias("_was"))
    full = F.filter(F.transform("_r", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"] != "")
    rows = rows.withColumn("_full", full).withColumn("_own", F.array_distinct(F.transform("_full", lambda x: x["line"])))
    # Lines of the file that the region has too; only these are compared with its lines.
    shared = F.filter(F.transform("_c", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: F.array_contains("_own", x["line"]))
    rows = rows.withColumns({"_shared": shared, "_size": F.size("_c"), "_first": F.get("_full", F.lit(0))["at"], "_last": F.get("_full", F.size("_full") - 1)["at"]})

    def vote(x: Column) -> Column:
        now = F.filter("_shared", lambda y: y["line"] == x["line"])
        edge = (x["at"] == F.col("_first")) | (x["at"] == F.col("_last"))
        return F.when(F.size(now) == 1, F.struct((F.get(now, F.lit(0))["at"] - x["at"]).alias("start_at"), edge.alias("edge")))

    fits = F.filter(F.transform("_full", vote), lambda v: (v["start_at"] >= 0) & (v["start_at"] + F.col("_n") <= F.col("_size")))
    rows = rows.withColumn("_votes", fits)

    def counted(s: Column) -> Column:
        mine = F.filter("_votes", lambda v: v["start_at"] == s)
        support = F.size(mine)
        return F.struct((-support).alias("order"), F.abs(s + 1 - F.col("_was")).alias("distance"), s.alias("start_at"), F.size(F.filter(mine, lambda v: ~v["edge"])).alias("interior"))

    starts = F.array_distinct(F.transform("_votes", lambda v: v["start_at"]))
    out = rows.select(*key, F.posexplode(F.array_sort(F.transform(starts, counted))).alias("_i", "_s"))
    return out.select(*key, "_s.start_at", (-F.col("_s.order")).cast("bigint").alias("support"), F.col("_s.interior").cast("bigint").alias("interior"), (F.col("_i") + 1).alias("rank"))


def consensus(votes: DataFrame, key: list[str]) -> DataFrame:
    """The first start of each region with enough votes (key, start_at, support)."""
    return votes.filter((F.col("rank") == 1) & (F.col("support") >= LEAST_VOTES)).select(*key, "start_at", "support")


def relocated(units: DataFrame, files: DataFrame, parser=None) -> DataFrame:
    """units (session, unit_id, path, scope, selector, content, start_line, end_line, file_lines) against files (session, path, content).

    Gives (session, unit_id, state, method, new_content, new_start, new_end). Files that are
    missing or null leave their units unresolved; their old text is never passed off as current.
    """
    now = files.select("session", "path", F.col("content").alias("current"))
    kinds, facts = dict(units.dtypes), ["path", "scope", "selector", "content", "start_line", "end_line", "file_lines", "current"]
    rows = units.join(now, ["session", "path"], "left").select("session", "unit_id", *facts)
    found_in = pa.schema([("state", pa.string()), ("method", pa.string()), ("new_content", pa.string()), ("new_start", pa.int64()), ("new_end", pa.int64())])

    def one(r: dict) -> dict:
        if r["current"] is None:
            return {"state": "unresolved", "method": "source-missing"}
        start, end, lines = (None if r[c] is None else int(r[c]) for c in ("start_line", "end_line", "file_lines"))
        unit = Unit(r["unit_id"], r["path"], r["scope"], r["selector"], r["content"], "", start, end, 0, 0, 0, Anchors.of(r["content"], start), file_lines=lines)
        found = resolve(unit, r["current"].replace("\r\n", "\n"), parser)
        return {"state": found.state, "method": found.method, "new_content": found.content, "new_start": found.start_line, "new_end": found.end_line}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows hold whole files; few at a time become Python objects, and what they give leaves before the next ones come.
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            out = pa.RecordBatch.from_pylist([one(r) for r in batch.select(["unit_id", *facts]).to_pylist()], schema=found_in)
            yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("unit_id"), *out.columns], names=["session", "unit_id", *found_in.names])

    return rows.mapInArrow(run, f"session {kinds['session']}, unit_id {kinds['unit_id']}, state string, method string, new_content string, new_start bigint, new_end bigint")


def refreshed(units: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """units after a refresh: text, span and revision of what was found; change counters where the revision differs."""
    from ..functions import ids

    rows = units.join(found, ["session", "unit_id"])
    ok = F.col("state") == "resolved"
    revision = F.when(ok, ids.revision(F.col("new_content"))).otherwise(F.col("revision"))
    changed = ok & (revision != F.col("revision"))
    return rows.select(
        "session", "unit_id", "path", "scope", "selector", "state", "method", F.when(ok, F.col("new_content")).otherwise(F.col("content")).alias("content"), revision.alias("revision"),
        F.when(ok, F.col("new_start")).otherwise(F.col("start_line")).alias("start_line"), F.when(ok, F.col("new_end")).otherwise(F.col("end_line")).alias("end_line"),
        (F.col("change_count") + changed.cast("int")).alias("change_count"), F.when(changed, F.lit(turn)).otherwise(F.col("changed_at")).alias("changed_at"),
    )


def failures(found: DataFrame) -> DataFrame:
    """Number of units by state and method."""
    return found.groupBy("state", "method").agg(F.count("*").alias("units"))
