"""Benchmark decontamination with spaced seeds.

A seed mask hashes the words at its chosen positions and ignores the others, so a passage
with replaced words still shares hashes with its source. The two masks MASKS together hit
every passage of SHORT_WORDS or more words of which a fifth was replaced, wherever: r
replaced words leave at least 4 r others in r + 1 runs. Without a hit of 11111 no run has
over 4, and without one of 111011 two neighbouring runs lack 2 of 4 each, so that five or
more replaced words leave too few others; fewer are enumerated by the tests. Passages of
fewer than SHORT_WORDS words have the shorter SHORT_MASKS, which do the same there.

Hashes of all windows of the benchmark items fill a Bloom filter; windows of the documents
that pass it are joined with the items' hashes, and each (item, offset) that meets is
verified by counting equal words along that offset, with one shift of up to SHIFT words for a
word added or lost. A document is contaminated where SIMILARITY or more of an item's words
are found.

Scale: the filter has a power of two of bits between 2^16 and 2^27 (16 MB), 32 or more for
each test hash up to 4 million of them; one in 5,000 other windows passes it then, and one in
40 at 16 million. The join decides exactly whatever passes. Documents are read once; equal
texts are handled once after that, and only stretches around hits move, of SPAN words and
their surroundings at most. Items are joined, not broadcast by us. Masks that no item has
are not looked for.

Cases: null, empty and blank texts are clean. Items of fewer than MIN_WORDS words, and null
items, are no passages and match nothing; items with the same words are one passage that
carries all their ids. Texts are searched whole. Repeated rows are all reported, rows
without doc_id as well. Empty documents or an empty benchmark give no leaks. Other columns
pass through, whatever their names; a column named item_ids or overlap is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, written

MASKS = ("11111", "111011")
#: Of items below SHORT_WORDS words.
SHORT_MASKS, SHORT_WORDS = ("1101", "1011"), 12
MIN_WORDS, SIMILARITY, SHIFT = 5, 0.8, 3
#: Words that are hashed together; words from the first to the last hit of one stretch.
WORDS_AT_ONCE, SPAN = 400_000, 4_096
#: Places that a hash has in the filter, and the powers of two of its bits.
PROBES, LEAST_BITS, MOST_BITS = 4, 16, 27

_WORD = re.compile(r"\w+")
_POSITIONS = [np.array([i for i, x in enumerate(m) if x == "1"]) for m in (*MASKS, *SHORT_MASKS)]
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & 0xFFFFFFFFFFFFFFFF) for i in range(8)]


class _Hashes(dict):
    """Hash of each word seen."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _words(texts: list[str], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text begins and the last ends."""
    lists = [_WORD.findall(x.lower()) if x else () for x in texts]
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.fromiter((hashes[w] for words in lists for w in words), dtype=np.uint64, count=int(ends[-1]))
    return flat, ends


def _masks(n: int) -> range:
    """Numbers of the masks that an item of n words has."""
    return range(len(MASKS), len(_POSITIONS)) if n < SHORT_WORDS else range(len(MASKS))


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash under mask k of the window at each position where it fits."""
    at = _POSITIONS[k]
    n = len(words) - int(at[-1])
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, k + 1, dtype=np.uint64)
    for j, p in enumerate(at):
        out = (out ^ words[p : p + n]) * _ODD[j]
        out ^= out >> np.uint64(32)
    return out


def passages(benchmark: DataFrame) -> DataFrame:
    """(passage, item_ids, words): the distinct word sequences of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            words, ends = _words(pdf["text"].tolist(), hashes)
            rows = [(i, words[a:b].view(np.int64)) for i, a, b in zip(pdf["item_id"], ends[:-1], ends[1:]) if b - a >= MIN_WORDS]
            yield pd.DataFrame(rows, columns=["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text IS NOT NULL").mapInPandas(run, "item_id bigint, words array<bigint>")
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(F.xxhash64("words").alias("passage"), "item_ids", "words")


def test_hashes(items: DataFrame) -> DataFrame:
    """(hash, passage, place) of all windows of the passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for passage, words in zip(pdf["passage"], pdf["words"]):
                for k in _masks(len(words)):
                    rows += [(h, passage, i) for i, h in enumerate(_windows(np.asarray(words, dtype=np.int64).view(np.uint64), k).view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["hash", "passage", "place"])

    return items.select("passage", "words").mapInPandas(run, "hash bigint, passage bigint, place int")


def bloom(hashes: DataFrame) -> np.ndarray:
    """Bit set of PROBES places of each hash, gathered as at most 2^21 words."""
    n = hashes.count()
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (32 * max(1, n) - 1).bit_length()))
    low = F.lit(bits - 1)
    first, step = F.col("hash").bitwiseAND(low), F.shiftright("hash", 32).bitwiseAND(low)
    place = F.explode(F.array(*((first + step * j).bitwiseAND(low) for j in range(PROBES))))
    places = hashes.select(place.alias("p"))
    words = places.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, dtype=np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that pass the filter."""
    low, left = np.uint64(len(bits) * 64 - 1), None
    for j in range(PROBES):
        own = h if left is None else h[left]
        p = ((own & low) + ((own >> np.uint64(32)) & low) * np.uint64(j)) & low
        ok = np.flatnonzero(bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1))
        left = ok if left is None else left[ok]
    return left


def _hits(batches: Iterator[pd.DataFrame], bits: np.ndarray, around: int, masks: list[int]) -> Iterator[pd.DataFrame]:
    """(text_key, seg, words, hits) of the stretches around windows that pass the filter."""
    hashes = _Hashes()
    for pdf in batches:
        texts, keys = pdf["text"].tolist(), pdf["text_key"].tolist()
        lengths = np.cumsum([0, *(len(x or "") // 5 + 1 for x in texts)])
        i = 0
        while i < len(texts):
            j = min(len(texts), max(i + 1, int(np.searchsorted(lengths, lengths[i] + WORDS_AT_ONCE))))
            words, ends = _words(texts[i:j], hashes)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            owner = np.repeat(np.arange(j - i), np.diff(ends))
            for k in masks:
                h = _windows(words, k)
                ok = passing(h, bits)
                ok = ok[owner[ok] == owner[ok + int(_POSITIONS[k][-1])]]
                found.append((ok, h[ok]))
            where = np.concatenate([x for x, _ in found])
            if len(where):
                what = np.concatenate([x for _, x in found]).view(np.int64)
                order = np.argsort(where, kind="stable")
                where, what = where[order], what[order]
                yield _stretches(where, what, words, ends, owner, keys[i:j], around)
            i = j


def _stretches(where, what, words, ends, owner, keys, around) -> pd.DataFrame:
    """Hits that lie close together and the words around them; a long run of hits is cut, and each part has its surroundings."""
    new = np.concatenate(([True], (np.diff(where) > 2 * around) | (np.diff(owner[where]) != 0)))
    part = (where - np.maximum.accumulate(np.where(new, where, 0))) // SPAN
    new[1:] |= part[1:] != part[:-1]
    first = np.flatnonzero(new)
    rows = []
    for seg, (a, b) in enumerate(zip(first, [*first[1:], len(where)])):
        doc = owner[where[a]]
        lo, hi = max(ends[doc], where[a] - around), min(ends[doc + 1], where[b - 1] + around + 1)
        hits = [{"hash": int(h), "place": int(p - lo)} for p, h in zip(where[a:b], what[a:b])]
        # Named by its place in the text, a stretch of equal texts is the same one.
        rows.append((keys[doc], int(where[a] - ends[doc]), short(words[lo:hi]), hits))
    return pd.DataFrame(rows, columns=["text_key", "seg", "words", "hits"])


def short(words: np.ndarray) -> np.ndarray:
    """The upper halves of word hashes, by which words are compared along an offset."""
    return (words >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similarity(item: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> float:
    """Largest share of the item's words found along one of the offsets, or along it up to some place and up to SHIFT beside it from there on."""
    best, n = 0, len(item)
    at_once = max(1, 100_000 // n)
    for i in range(0, len(offsets), at_once):
        part = offsets[i : i + at_once]
        at = np.unique((part[:, None] + np.arange(-SHIFT, SHIFT + 1)).ravel())
        index = at[:, None] + np.arange(n)
        same = (index >= 0) & (index < len(words)) & (words[np.clip(index, 0, len(words) - 1)] == item)
        before = np.zeros((len(at), n + 1), dtype=np.int32)
        np.cumsum(same, axis=1, out=before[:, 1:])
        after = before[:, -1:] - before
        own = np.searchsorted(at, part)
        for d in range(-SHIFT, SHIFT + 1):
            other = np.searchsorted(at, part + d)
            best = max(best, int((before[own] + after[other]).max()), int((before[other] + after[own]).max()))
            if best == n:
                return 1.0
    return best / n


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, passage, offsets, words, item in zip(pdf["text_key"], pdf["passage"], pdf["offsets"], pdf["words"], pdf["item"]):
            words, item = np.asarray(words), short(np.asarray(item, dtype=np.int64).view(np.uint64))
            rows.append((key, passage, similarity(item, words, np.asarray(offsets))))
        yield pd.DataFrame(rows, columns=["text_key", "passage", "overlap"])


def leaks(docs: DataFrame, benchmark: DataFrame, similarity_at_least: float = SIMILARITY) -> DataFrame:
    """(text_key, item_ids, overlap) of the contaminated texts; text_key is the MD5 of the text."""
    items = written(passages(benchmark), "passages")
    tests = written(test_hashes(items), "test-hashes")
    shortest, longest = (x or 0 for x in items.agg(F.min(F.size("words")), F.max(F.size("words"))).first())
    masks = sorted({*_masks(shortest), *_masks(longest)})
    bits = docs.sparkSession.sparkContext.broadcast(bloom(tests))
    around = int(longest) + SHIFT + 1
    texts = docs.select(F.md5("text").alias("text_key"), "text").filter("text IS NOT NULL")
    found = texts.mapInPandas(lambda it: _hits(it, bits.value, around, masks), "text_key string, seg bigint, words array<int>, hits array<struct<hash: bigint, place: int>>")
    # Equal texts have equal stretches under the same key; their copies are put together before the shuffle.
    found = written(found.groupBy("text_key", "seg").agg(F.first("words").alias("words"), F.first("hits").alias("hits")), "stretches")
    hits = found.select("text_key", "seg", F.explode("hits").alias("h")).select("text_key", "seg", F.col("h.hash").alias("hash"), F.col("h.place").alias("at"))
    meets = hits.join(tests, "hash").groupBy("text_key", "seg", "passage").agg(F.collect_set(F.col("at") - F.col("place")).alias("offsets"))
    whole = meets.join(items.select("passage", F.col("words").alias("item")), "passage").join(found.select("text_key", "seg", "words"), ["text_key", "seg"])
    checked = whole.mapInPandas(_verified, "text_key string, passage bigint, overlap double").filter(F.col("overlap") >= similarity_at_least - 1e-9)
    best = checked.groupBy("text_key", "passage").agg(F.max("overlap").alias("overlap")).join(items.select("passage", "item_ids"), "passage")
    return best.groupBy("text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("overlap").alias("overlap"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated rows of docs with item_ids and overlap."""
    found = written(leaks(docs, benchmark), "leaks")
    rows, back = numbered(docs, ("item_ids", "overlap"), key=F.md5(F.col("text")))
    return rows.join(found, rows["key"] == found["text_key"]).select(*back, "item_ids", "overlap")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    found = written(leaks(docs, benchmark), "leaks")
    rows, back = numbered(docs, key=F.md5(F.col("text")))
    return rows.join(found, rows["key"] == found["text_key"], "left_anti").select(*back)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_ids", F.size("item_ids").cast("bigint").alias("n_items"), "overlap")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return cleaned(docs, table(spark, sf_dir, "benchmark"))
