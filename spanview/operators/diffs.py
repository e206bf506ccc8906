"""Edit scripts between two versions of many texts, by lines.

The diff is a histogram diff over relations. Lines that occur once in either version of a stretch match each other; of these,
the heaviest chain that rises in both versions is kept (weights are bytes). The matches cut the stretch into smaller ones, in
which other lines may occur once, and so on. What is left has only repeated lines; there, dynamic programming finds the
heaviest common subsequence, in space of one row. Without moved lines the script keeps as many bytes as any script can; where
lines moved, it may keep fewer, never more.

Scale: all texts are diffed at once, in a few rounds over their lines. Equal lines of a pair get one number where the pair is
read, so what is written and moved is numbers, a few bytes a line, and no text. A line meets others by aggregation on (text, stretch,
line), never pair by pair, and lines that a stretch has in one version only leave at once. A text's lines stream through one
task in order; what a task holds is the unique lines of one stretch.

Cases: null is the empty text, whose only line is empty. Lines end at LF; a CR belongs to its line. A line weighs its UTF-8
bytes and one for its end. Repeated rows are diffed each for itself. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..shared import cut

_MATCH = "id bigint, i int, j int, weight bigint"
_ARROW = pa.schema([("id", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("weight", pa.int64())])


def heaviest_chain(points: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of points (i, j, weight) with rising i, those of a heaviest subsequence with rising j."""
    if all(a[1] < b[1] for a, b in zip(points, points[1:])):
        return points
    # Ends of chains by j: a chain is kept while no other ends before it and is as heavy.
    ends: list[int] = []
    best: list[tuple[int, int]] = []
    before: list[int] = []
    for at, (_, j, weight) in enumerate(points):
        k = bisect_right(ends, j)
        total, last = best[k - 1] if k else (0, -1)
        before.append(last)
        total += weight
        stop = k
        while stop < len(ends) and best[stop][0] <= total:
            stop += 1
        ends[k:stop], best[k:stop] = [j], [(total, at)]
    out, at = [], best[-1][1]
    while at >= 0:
        out.append(points[at])
        at = before[at]
    return out[::-1]


def _row(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The heaviest common subsequence of a with each start of b."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x, weight in zip(a, weights):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight * (b == x)))
    return row


def common_lines(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Places (in a, in b) of a heaviest common subsequence; weights are those of a. Space is one row: a is halved, and b where both halves keep most."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        found = np.flatnonzero(b == a[0])
        return [(0, int(found[0]))] if len(found) else []
    mid = len(a) // 2
    k = int((_row(a[:mid], b, weights[:mid]) + _row(a[mid:][::-1], b[::-1], weights[mid:][::-1])[::-1]).argmax())
    return common_lines(a[:mid], b[:k], weights[:mid]) + [(mid + i, k + j) for i, j in common_lines(a[mid:], b[k:], weights[mid:])]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that share their first width columns, which are in order; the rest of each row."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, itemgetter(*range(width))):
        yield key, [x[width:] for x in group]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 16_384:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches((key[0], *point) for key, points in _groups(batches, 2) for point in heaviest_chain(points))


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def matched() -> Iterator[tuple]:
        for key, rows in _groups(batches, 2):
            sides: tuple[list, list] = ([], [])
            for side, *x in rows:
                sides[side].append(x)
            a, b = (np.array([x[1] for x in side], dtype=np.int64) for side in sides)
            for i, j in common_lines(a, b, np.array([x[2] for x in sides[0]], dtype=np.int64)):
                yield key[0], sides[0][i][0], sides[1][j][0], sides[0][i][2]

    return _batches(matched())


def _numbered(texts: DataFrame) -> DataFrame:
    """texts (before, after, and other columns) with each text as an array of (line, weight): equal lines of a row's two texts have one number."""
    item = pa.struct([("line", pa.int32()), ("weight", pa.int64())])
    others = [c for c in texts.columns if c not in ("before", "after")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            ends, lines, weights = ([0], [0]), ([], []), ([], [])
            for r in range(batch.num_rows):
                number: dict[bytes, int] = {}
                for side in (0, 1):
                    own = (batch.column(len(others) + side)[r].as_py() or b"").split(b"\n")
                    lines[side].extend(number.setdefault(x, len(number)) for x in own)
                    weights[side].extend(len(x) + 1 for x in own)
                    ends[side].append(len(lines[side]))
            sides = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(w, pa.int64())], fields=list(item))) for e, x, w in zip(ends, lines, weights)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), *sides], names=[*others, "before", "after"])

    slim = texts.select(*others, *(F.col(c).cast("binary").alias(c) for c in ("before", "after")))
    lines = ArrayType(StructType([StructField("line", IntegerType()), StructField("weight", LongType())]))
    return slim.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in slim.schema if f.name in others), StructField("before", lines), StructField("after", lines)]))


def _side(numbered: DataFrame, side: int, text: str) -> DataFrame:
    return numbered.select("id", F.lit(side).alias("side"), F.posexplode(text).alias("i", "x")).select("id", "side", "i", "x.line", "x.weight")


def matched_lines(texts: DataFrame) -> DataFrame:
    """(id, i, j, weight): line i of before is kept as line j of after, for texts (id, before, after) with an id each."""
    return _matched(cut(_numbered(texts.select("id", "before", "after")), "diff-texts"))


def _matched(numbered: DataFrame) -> DataFrame:
    lines = _side(numbered, 0, "before").unionByName(_side(numbered, 1, "after")).withColumn("stretch", F.lit(0).cast("bigint"))
    stretch, out = ["id", "stretch", "line"], None
    while True:
        here = [F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)] + [F.min(F.when(F.col("side") == s, F.col("i"))).alias(c) for s, c in enumerate("ij")]
        both = cut(lines.groupBy(*stretch).agg(*here, F.first("weight").alias("weight")).filter("n0 > 0 AND n1 > 0"), "diff-shared")
        once = both.filter("n0 = 1 AND n1 = 1").select("id", "stretch", "i", "j", "weight")
        found = cut(once.repartition("id").sortWithinPartitions("id", "stretch", "i").mapInArrow(_chains, _MATCH), "diff-matches")
        # Lines of one version only match nothing.
        left = lines.join(both.select(*stretch), stretch, "left_semi")
        if found.isEmpty():
            order = ["id", "stretch", "side", "i"]
            rest = left.select(*order, "line", "weight").repartition("id").sortWithinPartitions(*order).mapInArrow(_rests, _MATCH)
            return rest if out is None else out.unionByName(rest)
        out = found if out is None else out.unionByName(found)
        marks = found.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("i")), F.struct(F.lit(1).alias("side"), F.col("j").alias("i")))).alias("m"))
        marks = marks.select("id", "m.side", "m.i", F.lit(1).alias("kept"))
        before = F.sum(F.coalesce("kept", F.lit(0))).over(Window.partitionBy("id", "side").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        # Matches stand in the same order in both versions, so the number before a line names its stretch in either.
        numbered = left.join(marks, ["id", "side", "i"], "left").withColumn("stretch", F.col("stretch") + before)
        lines = cut(numbered.filter("kept IS NULL").select(*lines.columns), "diff-lines")


def hunks(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, before_from, before_to, after_from, after_to): the changes between kept lines, in lines from 0, the ends not included."""
    return _hunks(texts.select("id", *(F.size(F.split(F.coalesce(c, F.lit("")), "\n", -1)).alias(k) for c, k in (("before", "i"), ("after", "j")))), matches)


def _hunks(ends: DataFrame, matches: DataFrame) -> DataFrame:
    rows = matches.select("id", "i", "j").unionByName(ends)
    order = Window.partitionBy("id").orderBy("i", "j")
    last = [(F.coalesce(F.lag(c).over(order), F.lit(-1)) + 1).alias(f"_{c}") for c in "ij"]
    out = rows.select("id", "i", "j", *last).filter("_i < i OR _j < j")
    return out.select("id", F.col("_i").alias("before_from"), F.col("i").alias("before_to"), F.col("_j").alias("after_from"), F.col("j").alias("after_to"))


def changed(pairs: DataFrame, texts: bool = True) -> DataFrame:
    """pairs (before, after, and any other columns) with removed_bytes and added_bytes, and hunks, the number of changes; without texts, before and after are neither written nor returned."""
    others = [c for c in pairs.columns if c not in ("before", "after")]
    carried = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("other")] if others else []
    whole = [F.struct("before", "after").alias("texts")] if texts else []
    rows = cut(_numbered(pairs.select(F.monotonically_increasing_id().alias("id"), *carried, *whole, "before", "after")), "diff-texts")
    matches = cut(_matched(rows), "diff-script")
    kept = matches.groupBy("id").agg(F.sum("weight").alias("kept"))
    n = _hunks(rows.select("id", F.size("before").alias("i"), F.size("after").alias("j")), matches).groupBy("id").agg(F.count("*").alias("hunks"))
    zero = F.lit(0).cast("bigint")
    sizes = [F.aggregate(c, zero, lambda acc, x: acc + x["weight"]).alias(k) for c, k in (("before", "_a"), ("after", "_b"))]
    # Sizes are taken before the joins, which then move no lines.
    found = rows.select("id", *(["other"] if others else []), *(["texts"] if texts else []), *sizes).join(kept, "id", "left").join(n, "id", "left")
    same = F.coalesce("kept", zero)
    return found.select(*(["other.*"] if others else []), *(["texts.*"] if texts else []), (F.col("_a") - same).alias("removed_bytes"), (F.col("_b") - same).alias("added_bytes"), F.coalesce("hunks", zero).alias("hunks"))
