"""Packing into as few sequences as possible, by the configuration linear program over the histogram of lengths.

Documents become ids and an end mark; what is longer than a sequence is cut into full pieces, of which the first may be
shorter. What counts from there on is how many pieces there are of each length. A configuration is a multiset of lengths that
fits into a sequence. The linear program wants as few configurations as cover the histogram:

* solved() runs multiplicative weights: a length is worth its tokens at first, and less as its share covered rises. Knapsack
  dynamic programming prices all configurations at once; those that are worth nearly the most, at most one for each length
  that it starts from, are taken in a step small enough for every length. The best prices also bound the optimum from below.
* rounded() takes configurations as often as the program does, the most used first, rounded up while pieces are left, if they
  are nearly full; the program is solved again for what is left while that pays. Best fit decreasing places the rest, in the
  space left first. Plain best fit decreasing over the histogram is kept instead where it needs fewer sequences.

assigned() gives pieces their places: the pieces of a length are numbered, and each configuration owns ranges of numbers.

Scale: each text is encoded once; only lengths and checksums are written. The driver gets one count a length, 2,048 at most,
and its work does not grow with the documents. Pieces are numbered by the task that made them and within it, so that a length
that a third of all pieces have is not one group; tasks' counts are added up by length. The places (at most a few a
configuration, GROUPS times as many as lengths) are sent to the tasks, some MB whatever the input.

Cases: null and empty texts are an end mark alone. Texts are encoded whole, however long (tokens.py). The strings of special
tokens in a text become those tokens, as the vocabulary's library has it. Rows without doc_id and repeated rows are packed like
others. Ties between pieces of a length go by task and row. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .tokens import TOKENIZERS, byte_bpe

VOCABULARY, END, LENGTH = "byte_bpe_50k.json", 0, 2_048
#: Steps of the linear program, the share of a length that a step covers at most, and how fast weights fall with the share covered.
STEPS, STEP, FALL = 60, 0.1, 3.0
#: Configurations worth this share of the best are taken in a step; those that leave at most this part of a sequence free are kept in rounding.
NEARLY, FREE = 0.98, 1 / 64
#: Times at most that the program is solved for what is left.
ROUNDS = 4

Histogram = dict[int, int]
#: (lengths with how often each stands in it, how many sequences are so filled).
Group = tuple[tuple[tuple[int, int], ...], int]

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"


# Lengths ---------------------------------------------------------------------


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def measured(docs: DataFrame, length: int = LENGTH, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """The pieces of docs (doc_id, text) with their task and their number among the pieces of their length in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, seen = byte_bpe(path), TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(known.encode(text.as_py() or "", special=True), np.array([END], dtype="<u2")).astype("<u4")
                for i, (start, n) in enumerate(pieces(len(ids), length)):
                    rows.append((doc_id, i, start, n, zlib.crc32(ids[start : start + n].data), task, seen[n]))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _PIECES)


# The linear program ----------------------------------------------------------


class Knapsack:
    """The best value of each capacity up to most, where a length (1 to most) may be taken any number of times; ties go to long ones."""

    def __init__(self, values: np.ndarray, most: int):
        self.best, self.taken = np.zeros(most + 1), np.zeros(most + 1, dtype=np.int64)
        best, taken, backwards = self.best, self.taken, values[::-1].copy()
        for c in range(1, most + 1):
            sums = backwards[most - c : most] + best[:c]
            k = int(sums.argmax())
            if sums[k] > best[c - 1]:
                best[c], taken[c] = sums[k], c - k
            else:
                best[c] = best[c - 1]

    def filled(self, capacity: int) -> dict[int, int]:
        """The lengths of a best filling."""
        out: dict[int, int] = {}
        while capacity > 0:
            n = int(self.taken[capacity])
            if n:
                out[n] = out.get(n, 0) + 1
            capacity -= n or 1
        return out


def solved(histogram: Histogram, most: int = LENGTH, steps: int = STEPS) -> tuple[dict[tuple, float], float]:
    """(configurations with how often each is used, a bound from below on the number of sequences): a cover of the histogram in fractions."""
    if not histogram:
        return {}, 0.0
    lengths = np.array(sorted(histogram))
    wanted = np.array([histogram[int(n)] for n in lengths], dtype=np.float64)
    place = {int(n): i for i, n in enumerate(lengths)}
    covered, used, bound = np.zeros(len(lengths)), {}, 0.0
    for _ in range(steps):
        weights = lengths * np.exp(-FALL * (covered - covered.mean()))
        values = np.zeros(most + 1)
        values[lengths] = weights
        priced = Knapsack(values, most)
        top = priced.best[most]
        bound = max(bound, float((weights * wanted).sum() / top))
        chosen = {}
        for i in np.flatnonzero(weights + priced.best[most - lengths] >= NEARLY * top):
            n = int(lengths[i])
            one = priced.filled(most - n)
            one[n] = one.get(n, 0) + 1
            chosen[tuple(sorted(one.items(), reverse=True))] = None
        load = np.zeros(len(lengths))
        for one in chosen:
            for n, k in one:
                load[place[n]] += k / wanted[place[n]]
        for one in chosen:
            step = STEP / max(load[place[n]] for n, _ in one)
            used[one] = used.get(one, 0.0) + step
            for n, k in one:
                covered[place[n]] += k * step / wanted[place[n]]
    scale = 1 / covered.mean()
    return {one: x * scale for one, x in used.items()}, bound


def best_fit(histogram: Histogram, most: int = LENGTH, begun: list[Group] = ()) -> list[Group]:
    """Best fit decreasing, for many pieces of a length at once, into begun and new sequences: groups of sequences that are filled alike."""
    open_: dict[int, list[list]] = {}
    capacities: list[int] = []
    done: list[Group] = []

    def put(free: int, filling: tuple, times: int) -> None:
        if not free:
            done.append((filling, times))
            return
        if free not in open_:
            open_[free] = []
            insort(capacities, free)
        open_[free].append([filling, times])

    for filling, times in begun:
        put(most - sum(n * k for n, k in filling), filling, times)
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            at = bisect_left(capacities, n)
            if at == len(capacities):
                k = most // n
                if left // k:
                    put(most - k * n, ((n, k),), left // k)
                if left % k:
                    put(most - left % k * n, ((n, left % k),), 1)
                break
            free = capacities[at]
            filling, times = open_[free].pop()
            if not open_[free]:
                del open_[free]
                capacities.pop(at)
            k = min(free // n, left)
            t = min(times, left // k)
            left -= t * k
            put(free - k * n, (*filling, (n, k)), t)
            if times > t:
                put(free, filling, times - t)
    return done + [(filling, times) for groups in open_.values() for filling, times in groups]


def rounded(histogram: Histogram, most: int = LENGTH, steps: int = STEPS) -> list[Group]:
    """Groups of sequences that hold the histogram exactly, in as few sequences as the linear program, rounded, or best fit decreasing gives."""
    plain, left, out = best_fit(histogram, most), dict(histogram), []
    for _ in range(ROUNDS):
        taken, before = 0, sum(n * k for n, k in left.items())
        for one, x in sorted(solved(left, most, steps)[0].items(), key=lambda p: (-p[1], p[0])):
            kept = tuple((n, min(k, left[n])) for n, k in one if left.get(n))
            filled = sum(n * k for n, k in kept)
            if filled < (1 - FREE) * most:
                continue
            times = min(-int(-x // 1), *(left[n] // k for n, k in kept))
            out.append((kept, times))
            for n, k in kept:
                left[n] -= k * times
            taken += times * filled
        left = {n: k for n, k in left.items() if k}
        if taken < before / 4 or not left:
            break
    out = best_fit(left, most, out)
    return min(out, plain, key=lambda groups: sum(times for _, times in groups))


# Places ----------------------------------------------------------------------


class Places:
    """Where the pieces of each length go: the piece numbered r of a length to a sequence and an offset in it."""

    def __init__(self, groups: list[Group], most: int = LENGTH):
        rows, seen, sequence = [], {}, 0
        for filling, times in groups:
            offset = 0
            for n, k in filling:
                rows.append((n, seen.get(n, 0), sequence, k, offset))
                seen[n] = seen.get(n, 0) + k * times
                offset += n * k
            sequence += times
        self.n_sequences = sequence
        self.rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        #: Where each length's rows begin, so that one search finds the row of a number.
        self.begin = np.searchsorted(self.rows[:, 0], np.arange(most + 2))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), dtype=np.int64)
        for n in np.unique(length):
            mine = length == n
            a, b = self.begin[n], self.begin[n + 1]
            at[mine] = a + np.searchsorted(self.rows[a:b, 1], rank[mine], side="right") - 1
        _, first, sequence, k, offset = self.rows[at].T
        return sequence + (rank - first) // k, offset + (rank - first) % k * length


def assigned(found: DataFrame, most: int = LENGTH, steps: int = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of found (a written table)."""
    spark = found.sparkSession
    counts = written(found.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(rounded(histogram, most, steps), most))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("task", "length", (F.sum("n").over(order) - F.col("n")).alias("before"))
    numbered = found.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, rank = batch.columns
            sequence, offset = places.value.of(kept[3].to_numpy(), rank.to_numpy())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def op12_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(written(measured(table(spark, sf_dir, "documents")), "packing-pieces"))
