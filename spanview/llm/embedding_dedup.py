"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine t or more lie within epsilon = sqrt(2 - 2 t) of each other, and so
do their projections on any orthonormal directions. Vectors are put in grid order: by label,
then by their cells of width epsilon on the LEADING principal directions, the first most
significant. The sequence is cut into intervals of up to BLOCK vectors. Intervals of one
label whose boxes come within epsilon are joined recursively: an interval pair is skipped
when its boxes are farther apart than epsilon in the leading directions, else halved, until
both have LEAF vectors at most, whose cosines are computed in double precision.

Scale: equal vectors of a label are joined once, with their number. Intervals are formed by
a range partitioning of the sequence, so no label or cell meets in one task. Pairs of
intervals come from their boxes alone, by an equality join on the cells of the first two
directions. A task's unit of work is a pair of groups of GROUP consecutive intervals, so that an
interval's vectors move once for all its partners in a group. A pair gives link counts for its
vectors and the links of a spanning forest, so a group of copies of any size gives linearly
many rows. Directions come from a sample of SAMPLE vectors, chosen by hash; they decide what
is skipped early, never what links.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null label, link with nothing. Vectors of different lengths do not link. Rows
without vec_id count as links of others, but name no component. Repeated rows are
vectors of their own that link with each other. Ties cannot occur; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, written
from .components import components

COSINE = 0.98
LEADING, BLOCK, GROUP, LEAF, SAMPLE = 6, 2_048, 4, 128, 4_096

_USABLE = (
    "label is not null and embedding is not null and size(embedding) > 0"
    " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"
)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    out = vectors.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def directions(vectors: DataFrame, k: int = LEADING) -> dict[int, np.ndarray]:
    """Leading principal directions (length x k) for the most frequent length among sampled vectors."""
    rows = [x[0] for x in vectors.orderBy("k1", "k2").limit(SAMPLE).select("embedding").collect()]
    if not rows:
        return {}
    lengths = [len(x) for x in rows]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    sample = unit(np.array([x for x in rows if len(x) == d]))
    sample -= sample.mean(axis=0)
    _, axes = np.linalg.eigh(sample.T @ sample)
    return {d: axes[:, ::-1][:, :k].copy()}


def project(units: np.ndarray, axes: dict[int, np.ndarray], k: int = LEADING) -> np.ndarray:
    """Places along the leading directions; vectors of other lengths use their first coordinates."""
    d = units.shape[1]
    out = units @ axes[d] if d in axes else units[:, :k]
    return out if out.shape[1] == k else np.pad(out, ((0, 0), (0, k - out.shape[1])))


def _celled(axes: dict[int, np.ndarray], epsilon: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["embedding"].map(len)):
                cells = np.floor(project(unit(np.stack(part["embedding"].to_numpy())), axes) / epsilon).astype(np.int32)
                yield part.assign(dim=len(part["embedding"].iloc[0]), **{f"c{i}": cells[:, i] for i in range(LEADING)})

    return run


def _intervals(axes: dict[int, np.ndarray], block: int, epsilon: float):
    """Consecutive rows of one label and length, up to block of them, as one row with their box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, number = TaskContext.get().partitionId() << 32, 0
        rest: pd.DataFrame | None = None
        for pdf in _then_none(batches):
            if pdf is not None:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            out = []
            while rest is not None and len(rest):
                label, dim = rest["label"].to_numpy(), rest["dim"].to_numpy()
                same = (label == label[0]) & (dim == dim[0])
                n = len(rest) if same.all() else int(np.argmin(same))
                if n == len(rest) and n < block and pdf is not None:
                    break
                part, rest = rest[: min(n, block)], rest[min(n, block) :].reset_index(drop=True)
                raw = np.stack(part["embedding"].to_numpy())
                places = project(unit(raw), axes)
                out.append({
                    "block": top + number, "cells": [{"x": int(i), "y": int(j)} for i, j in np.unique(np.floor(places[:, :2] / epsilon).astype(np.int32), axis=0)], "label": label[0], "dim": int(dim[0]), "lo": places.min(axis=0), "hi": places.max(axis=0),
                    "raw": raw.astype(raw.dtype.newbyteorder("<")).tobytes(), "wide": raw.dtype.itemsize == 8,
                    "uids": part["uid"].to_numpy(dtype="<i8").tobytes(), "copies": part["copies"].to_numpy(dtype="<i8").tobytes(),
                })
                number += 1
            if out:
                yield pd.DataFrame(out)

    return run


def _then_none(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


class Interval:
    """Vectors of one block, in grid order."""

    def __init__(self, dim: int, raw: bytes, wide: bool, uids: bytes, copies: bytes, axes: dict[int, np.ndarray]):
        self.units = unit(np.frombuffer(raw, dtype="<f8" if wide else "<f4").reshape(-1, dim))
        self.places = project(self.units, axes)
        self.uids, self.copies = np.frombuffer(uids, dtype="<i8"), np.frombuffer(copies, dtype="<i8")
        self.links = np.zeros(len(self.uids), dtype=np.int64)

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.places[a:b]
        return part.min(axis=0), part.max(axis=0)


def join_intervals(x: Interval, y: Interval, cosine: float, epsilon: float) -> list[tuple[int, int]]:
    """Adds to the link counts of x and y, and returns a spanning forest of their links as uid pairs; y may be x."""
    same, edges = x is y, []
    offset = 0 if same else len(x.uids)
    root = np.arange(len(x.uids) + (0 if same else len(y.uids)))
    stack = [(0, len(x.uids), 0, len(y.uids))]
    while stack:
        a, b, c, d = stack.pop()
        (lo1, hi1), (lo2, hi2) = x.box(a, b), y.box(c, d)
        gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
        if gap @ gap > epsilon * epsilon:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            linked = x.units[a:b] @ y.units[c:d].T >= cosine
            if same and a == c:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            x.links[a:b] += linked @ y.copies[c:d]
            if not same or a != c:
                y.links[c:d] += linked.T @ x.copies[a:b]
            # One link a row and tree is enough for the forest, and none between what one tree holds already.
            apart = linked & (root[a:b, None] != root[None, offset + c : offset + d])
            for i in np.flatnonzero(apart.any(axis=1)).tolist():
                others = np.flatnonzero(linked[i])
                trees, first = np.unique(root[offset + c + others], return_index=True)
                new = trees != root[a + i]
                if new.any():
                    edges += [(int(x.uids[a + i]), int(y.uids[c + j])) for j in others[first[new]].tolist()]
                    joined = np.append(trees[new], root[a + i])
                    root[np.isin(root, joined)] = joined.min()
            continue
        m, n = (a + b) // 2 if b - a > LEAF else b, (c + d) // 2 if d - c > LEAF else d
        for p, q in ((a, m), (m, b)):
            for r, s in ((c, n), (n, d)):
                if p < q and r < s and not (same and r < p):
                    stack.append((p, q, r, s))
    return edges


def _joined(axes: dict[int, np.ndarray], cosine: float, epsilon: float):
    """Links within a group of intervals, or between two."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = key
        pdf = pdf.sort_values("block", ignore_index=True)
        intervals = [Interval(r.dim, r.raw, r.wide, r.uids, r.copies, axes) for r in pdf.itertuples(index=False)]
        kind, group = list(zip(pdf["label"], pdf["dim"])), pdf["group"].tolist()
        counts, edges = [], []
        for i, x in enumerate(intervals):
            for j in range(i, len(intervals)):
                if kind[i] == kind[j] and (group[i], group[j]) == (one, two):
                    edges += join_intervals(x, intervals[j], cosine, epsilon)
        for x in intervals:
            counts += [(False, int(u), int(n)) for u, n in zip(x.uids, x.links) if n]
        return pd.DataFrame([*counts, *((True, a, b) for a, b in edges)], columns=["edge", "a", "b"])

    return run


def linked(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    usable = F.coalesce(F.expr(_USABLE), F.lit(False))
    keyed = rows.filter(usable).withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64("embedding", "label", F.lit(1))})
    distinct = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct = written(distinct.withColumn("uid", F.monotonically_increasing_id()), "vectors")

    axes = directions(distinct)
    cells = [f"c{i}" for i in range(LEADING)]
    celled = distinct.select("uid", "copies", "label", "embedding").mapInPandas(
        _celled(axes, epsilon), f"uid bigint, copies bigint, label string, embedding {dict(distinct.dtypes)['embedding']}, dim int, {', '.join(f'{c} int' for c in cells)}"
    )
    sequence = celled.repartitionByRange("label", "dim", *cells, "uid").sortWithinPartitions("label", "dim", *cells, "uid")
    sequence = sequence.mapInPandas(
        _intervals(axes, block, epsilon), "block bigint, cells array<struct<x: int, y: int>>, label string, dim int, lo array<double>, hi array<double>, raw binary, wide boolean, uids binary, copies binary"
    )
    blocks = written(sequence.withColumn("group", F.floor(F.col("block") / GROUP).cast("bigint")), "intervals")

    def beside(c: Column) -> Column:
        return F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((c["x"] + i).alias("x"), (c["y"] + j).alias("y")))))

    boxes = blocks.select("block", "group", "label", "dim", "lo", "hi", "cells")
    one = boxes.withColumn("cell", F.explode("cells")).drop("cells")
    cells_beside = F.explode(F.array_distinct(F.flatten(F.transform("cells", beside))))
    two = boxes.select(F.col("block").alias("block2"), F.col("group").alias("group2"), "label", "dim", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), cells_beside.alias("cell"))
    gaps = F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= epsilon * epsilon
    pairs = one.join(two, ["label", "dim", "cell"]).filter((F.col("block") <= F.col("block2")) & near).select("group", "group2").distinct()
    # Block numbers rise with the sequence, so that a pair of blocks is in the unit of their groups alone.
    sides = pairs.select(F.col("group").alias("one"), F.col("group2").alias("two"), F.explode(F.array_distinct(F.array("group", "group2"))).alias("group"))
    work = sides.join(blocks.select("group", "block", "label", "dim", "raw", "wide", "uids", "copies"), "group")
    found = written(work.groupBy("one", "two").applyInPandas(_joined(axes, cosine, epsilon), "edge boolean, a bigint, b bigint"), "vector-links")

    counts = found.filter("not edge").groupBy(F.col("a").alias("uid")).agg(F.sum("b").alias("n"))
    classes = components(found.filter("edge").select("a", "b")).withColumnRenamed("node", "uid")
    named = distinct.select("k1", "k2", "uid", "least", "copies").join(counts, "uid", "left").join(classes, "uid", "left")
    named = named.withColumn("component", F.coalesce("component", "uid"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id")).select(spread(F.col("component")).alias("component"), "component_id")
    of = named.join(smallest, "component").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "k1", "k2").join(of, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
