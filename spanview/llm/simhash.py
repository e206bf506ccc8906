"""Near-duplicates by SimHash, with bit-sliced comparison of fingerprints.

A fingerprint's bit is set where over half of the text's shingle hashes (XXH64, seed 42)
have it. Two fingerprints link at RADIUS or fewer differing bits. Any such pair agrees
wholly on at least `agree` of `blocks` bit blocks, so fingerprints meet in buckets keyed by
those blocks, which loses no link. Inside a bucket the fingerprints' bits are held as
planes, 64 fingerprints to a word; one pass over the planes adds up the differences of 64
pairs in three carry-save counter bits and drops words of which no pair can link any more.

Scale: texts are read once, and from there on only 8-byte distinct fingerprints move. The
bucket plan follows the number of distinct fingerprints. Buckets of over BUCKET of them
are dealt on by further blocks of the bits that their keys leave open, again without loss;
what is still over BUCKET when few bits are open meets in pairs of slices. A task keeps the
links of a spanning forest only, at most one for each row that it read.

Cases: null, empty or blank texts have fingerprint zero and link like any others; texts of
fewer words than a shingle are one shingle. Repeated rows and equal texts share a fingerprint.
Rows without doc_id get a fingerprint, and the smallest id of their group; null where the
group has none. Ties for the document that stays go to the smaller id, then the
row read first. Empty tables give empty results. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import numbered, spread, table, written
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a bucket that one task compares at once, and of several small buckets together.
BUCKET, BATCH = 16_384, 131_072
#: Expected fingerprints in a bucket of the first plan.
FILL = 2_048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text; words are ASCII-lower-cased runs without ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 8192):
        counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], dtype=np.uint64).view(np.int64))


def fingerprinted(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs, and fp (bigint)."""
    return docs.select(*keep, fingerprint_of(F.col("text").cast("binary")).alias("fp"))


# Bucket keys -----------------------------------------------------------------


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of about equally many bits that together cover bits."""
    return [sum(1 << b for b in bits[i * len(bits) // parts : (i + 1) * len(bits) // parts]) for i in range(parts)]


def first_masks(n: int, radius: int = RADIUS, fill: int = FILL) -> list[int]:
    """Bit masks such that any pair within radius agrees on one of them; about fill of n fingerprints share a key."""
    for agree in range(1, 5):
        blocks = radius + agree
        if n / 2 ** (64 * agree / blocks) <= fill or agree == 4:
            return [sum(x) for x in combinations(_cut(list(range(64)), blocks), agree)]
    raise AssertionError


def next_masks(mask: int, radius: int = RADIUS) -> list[int]:
    open_bits = [b for b in range(64) if not mask >> b & 1]
    return [mask | x for x in _cut(open_bits, radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, masks: dict[int | None, list[int]]) -> DataFrame:
    """(mask, key, part, fp) for the masks that follow each row's mask."""
    if None in masks:
        into = F.array(*(F.lit(_signed(m)) for m in masks[None]))
    else:
        table_of = F.create_map(*(x for k, v in masks.items() for x in (F.lit(_signed(k)), F.array(*(F.lit(_signed(m)) for m in v)))))
        into = table_of[F.col("mask")]
    out = rows.select("fp", F.explode(into).alias("mask"))
    return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), F.lit(0).alias("part"), "fp")


def buckets(fps: DataFrame, n: int, radius: int = RADIUS, limit: int = BUCKET) -> list[DataFrame]:
    """Frames (mask, key, part, fp) of which each group (mask, key, part) has about limit rows at most."""
    masks = first_masks(n, radius)
    rows, out = _keyed(fps, {None: masks}), []
    if n <= limit:
        return [rows]
    for level in range(4):
        sizes = rows.groupBy("mask", "key").count().filter(F.col("count") > limit)
        big = written(sizes, "big-buckets")
        if big.isEmpty():
            return [*out, rows]
        out.append(rows.join(big, ["mask", "key"], "left_anti").select("mask", "key", "part", "fp"))
        held = rows.join(big, ["mask", "key"])
        if level == 3 or any(bin(m).count("1") > 44 for m in masks):
            # Few bits are open. Slices of the bucket meet pairwise: row i of k slices goes to the k parts that hold slice i.
            k = F.ceil(F.col("count") * 2 / limit)
            mine = F.pmod(F.xxhash64("fp"), k)
            pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda j: F.least(mine, j) * k + F.greatest(mine, j))
            out.append(held.select("mask", "key", F.explode(pairs).alias("part"), "fp"))
            return out
        following = {m: next_masks(m, radius) for m in masks}
        rows = _keyed(held, following)
        masks = sorted({x for v in following.values() for x in v})
    raise AssertionError


# Bit-sliced comparison -------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, 64 fingerprints to a word, with one word of padding."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 8), dtype=np.uint8)
    bits[: len(fps)] = fps.view(np.uint8).reshape(-1, 8)
    unpacked = np.unpackbits(bits, axis=1, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(np.ascontiguousarray(unpacked.T), axis=1, bitorder="little")).view(np.uint64)
    return np.concatenate([packed, np.zeros((64, 1), dtype=np.uint64)], axis=1)


def within(p: np.ndarray, step: int, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Rows i of the planes p, of those whose bits in wanted are set, that differ from row i + step in radius bits at most (radius < 7)."""
    at = np.flatnonzero(wanted)
    alive = wanted[at]
    far, shift = step // 64, np.uint64(step % 64)
    back = np.uint64(64 - step % 64)
    c0, c1, c2 = (np.zeros(len(at), dtype=np.uint64) for _ in range(3))
    width = p.shape[1] - 1
    for first in range(0, 64, 8):
        for plane in p[first : first + 8]:
            other = plane[np.minimum(at + far, width)]
            if shift:
                other = (other >> shift) | (plane[np.minimum(at + far + 1, width)] << back)
            carry = plane[at] ^ other
            # The counter saturates at 7: counts only rise, and 7 is beyond the radius.
            full = c0 & c1 & c2
            carry &= ~full
            c0, carry = c0 ^ carry, c0 & carry
            c1, carry = c1 ^ carry, c1 & carry
            c2 = c2 ^ carry
        beyond = _over(c0, c1, c2, radius)
        alive &= ~beyond
        left = np.flatnonzero(alive)
        if len(left) < len(at):
            at, alive, c0, c1, c2 = (x[left] for x in (at, alive, c0, c1, c2))
            if not len(at):
                return at
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return np.sort(at[word] * 64 + bit)


def _over(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Where the three-bit count is above radius."""
    above, same = np.zeros_like(c0), ~np.zeros_like(c0)
    for c, bit in ((c2, radius >> 2 & 1), (c1, radius >> 1 & 1), (c0, radius & 1)):
        if bit:
            same &= c
        else:
            above |= same & c
            same &= ~c
    return above


def forest(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that link, within groups of adjacent rows, as a spanning forest of all links."""
    n = len(fps)
    root, p, out = np.arange(n), planes(fps), []
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size_of = np.diff(np.concatenate((first, [n])))
    size = np.repeat(size_of, size_of)
    place = np.arange(n) - np.repeat(first, size_of)
    active = np.flatnonzero(size > 1)
    step = 0
    while True:
        step += 1
        active = active[place[active] + step < size[active]]
        if not len(active):
            return out
        open_pairs = active[root[active] != root[active + step]]
        if not len(open_pairs):
            if step % 16 == 0:  # groups that are one tree already need no more steps
                whole = np.maximum.reduceat(root, first) == np.minimum.reduceat(root, first)
                active = active[~np.repeat(whole, size_of)[active]]
            continue
        wanted = np.zeros(p.shape[1] - 1, dtype=np.uint64)
        np.bitwise_or.at(wanted, open_pairs // 64, np.uint64(1) << (open_pairs % 64).astype(np.uint64))
        found = within(p, step, wanted, radius)
        if len(found):
            for i in found.tolist():
                a, b = i, i + step
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                while root[b] != b:
                    root[b] = root[root[b]]
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((i, i + step))
            while not np.array_equal(up := root[root], root):
                root = up


def _linked(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (mask, key, part): the forest of each batch of whole groups."""
    rest: list[pd.DataFrame] = []
    held = 0

    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        same = (pdf[["mask", "key", "part"]].to_numpy()[1:] == pdf[["mask", "key", "part"]].to_numpy()[:-1]).all(axis=1)
        group = np.concatenate(([0], np.cumsum(~same)))
        fps = pdf["fp"].to_numpy(dtype=np.int64)
        pairs = np.array(forest(fps.view(np.uint64), group, radius), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fps[pairs[:, 0]], "b": fps[pairs[:, 1]]})

    for pdf in batches:
        rest.append(pdf)
        held += len(pdf)
        if held < BATCH:
            continue
        all_rows = pd.concat(rest, ignore_index=True)
        keys = all_rows[["mask", "key", "part"]].to_numpy()
        ends = np.flatnonzero((keys[:-1] != keys[1:]).any(axis=1))
        if not len(ends):
            rest, held = [all_rows], len(all_rows)
            continue
        cut = int(ends[-1]) + 1
        yield flush(all_rows[:cut])
        rest, held = [all_rows[cut:]], len(all_rows) - cut
    if held:
        yield flush(pd.concat(rest, ignore_index=True))


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): enough of the links between the distinct fingerprints fps to reach all that links reach."""
    out = None
    for rows in buckets(fps, n, radius):
        dealt = rows.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part", "fp")
        found = dealt.mapInPandas(lambda it: _linked(it, radius), "a bigint, b bigint")
        out = found if out is None else out.unionByName(found)
    return out


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) for the fingerprints of fps that link with others; component is the smallest of them as a signed number."""
    distinct = written(fps.select("fp").distinct(), "fingerprints")
    return components(links(distinct, distinct.count(), radius)).withColumnRenamed("node", "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = written(fingerprinted(table(spark, sf_dir, "documents"), "doc_id"), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(classes(fps), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id")).select(spread(F.col("component")).alias("component"), "component_id")
    of = named.select("fp", "component").join(smallest, "component").select(spread(F.col("fp")).alias("fp"), "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id."""
    # Row ids and fingerprints are fixed by writing them beside the rows; the texts are hashed once.
    rows, back = numbered(docs, fp=fingerprint_of(F.col("text").cast("binary")), uid=F.monotonically_increasing_id(), doc=F.col("doc_id"))
    rows = written(rows, "simhash-rows")
    rank = F.struct(F.col("doc").isNull().alias("no_id"), F.col("doc"), F.col("uid"))
    best = rows.groupBy("fp").agg(F.min(rank).alias("best"))
    named = best.join(classes(rows), "fp", "left")
    stay = named.groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("best").alias("best")).select(F.col("best.uid").alias("uid"))
    return rows.join(stay, "uid", "left_semi").select(*back)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return deduplicated(docs)
