"""Alignment of two tokenizers' tokens over the same bytes: groups between common ends, and links between overlapping tokens.

A encodes a space and the text, B the text, before which it puts a space itself. Each token ends at a byte, and a document is
two lists of end events. encoded() puts them out as blocks of ids with the byte at which a block begins (an id fixes its
token's length). aligned() deals the blocks of both sides out by document, sorts them by place within partitions, and sweeps
them: what both sides have up to their last common end is complete and is counted, linked and hashed; what goes beyond it
waits. Between two neighbouring ends of either side there is one token of A and one of B, so those pairs are the links.

counted() counts, for each pair of ids, the documents in which it is linked, and adds the counts up for each document. Few
pairs are in most documents: those of the largest counts, HEAD at most, are sent to all tasks, and only the rest is shuffled,
so that no frequent pair meets in one task.

Scale: texts are encoded once, in stretches; two bytes a token are shuffled. The sweep holds a block of either side, the
longest group, and the distinct pairs of one document. The numbers of a pair's neighbours in a window are bounded by the
vocabulary. A long document is swept by one task, as its hash is one, in constant memory.

Cases: null and empty texts, and texts that B does not give back byte for byte, have no tokens: zeros and an empty hash.
Texts are encoded whole, however long. Rows without doc_id and repeated rows are documents of their own, and count as such.
Ties for a token's best pair all count. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, table, written
from .tokens import STRETCH, TOKENIZERS, byte_bpe

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ids of a block; pairs of the largest counts that all tasks get.
BLOCK, HEAD = 8_192, 400_000
A, B, NONE = 0, 1, 2

_BLOCKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())])
_SWEPT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
])


# Tokens ----------------------------------------------------------------------


class PieceBPE:
    """A vocabulary of pieces whose spaces are U+2581, with single bytes for what it lacks."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on over a space")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.space = self.model.piece_to_id("▁")

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint16) of a space and the text. No piece has a space after another character, so a long text is cut before such spaces."""
        out, at = [], 0
        while True:
            # From at on, a space and text: the model puts the space of the first stretch, and the text's own stands for those of the others.
            to = at + STRETCH if len(text) - at > 2 * STRETCH else len(text)
            while to < len(text) and not (text[to] == " " and text[to - 1] != " "):
                to = text.find(" ", to + 1)
                to = len(text) if to < 0 else to
            out.append(np.array(self.model.encode(text[at:to]) if to > at else [self.space], dtype="<u2"))
            if to >= len(text):
                return np.concatenate(out)
            at = to + 1

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_pieces: dict[str, PieceBPE] = {}


def piece_bpe(path: str) -> PieceBPE:
    """The vocabulary of a file, read once a process."""
    if path not in _pieces:
        _pieces[path] = PieceBPE(path)
    return _pieces[path]


def _column(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def encoded(docs: DataFrame, tokenizers: str = TOKENIZERS, block: int = BLOCK) -> DataFrame:
    """Blocks (row, doc_id, at, side, ids) of the tokens of docs (doc_id, text); a document without tokens has one of side NONE. row numbers the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_bpe(f"{tokenizers}/{A_FILE}"), piece_bpe(f"{tokenizers}/{B_FILE}")
        rows, held = [], 0
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text, sides = text.as_py() or "", ()
                if text:
                    ids = b.encode(text)
                    if b.decoded(ids) == b" " + text.encode():
                        sides = (A, a.encode(" " + text), a.lengths), (B, ids, b.lengths)
                if not sides:
                    rows.append((row, doc_id, 0, NONE, b""))
                for side, ids, lengths in sides:
                    at = 0
                    for i in range(0, len(ids), block):
                        part = ids[i : i + block]
                        rows.append((row, doc_id, at, side, part.tobytes()))
                        at += int(lengths[part].sum())
                        held += len(part)
                if held > 2_000_000 or len(rows) >= 10_000:
                    yield _column(rows, _BLOCKS)
                    rows, held = [], 0
        if rows:
            yield _column(rows, _BLOCKS)

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return read.mapInArrow(run, "row bigint, doc_id bigint, at bigint, side int, ids binary")


# The sweep -------------------------------------------------------------------


class Sweep:
    """One document: takes its blocks in order of their places, and holds no more than goes beyond the last common end."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], names: tuple[np.ndarray, ...]):
        self.lengths, self.names = lengths, names
        self.ids = [np.zeros(0, dtype=np.int64)] * 2
        self.ends = [np.zeros(0, dtype=np.int64)] * 2
        self.n, self.groups, self.links, self.tried = [0, 0], 0, 0, 0
        self.hash = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, side: int, at: int, ids: np.ndarray) -> None:
        self.ids[side] = np.concatenate((self.ids[side], ids))
        self.ends[side] = np.concatenate((self.ends[side], at + np.cumsum(self.lengths[side][ids])))
        self.n[side] += len(ids)
        held = min(len(self.ids[A]), len(self.ids[B]))
        # While no common end comes, what waits is looked through again only once it has doubled.
        if held > 2 * self.tried and held > BLOCK // 2:
            self.advance()

    def advance(self) -> None:
        """Count what is complete."""
        (ids_a, ids_b), (ends_a, ends_b) = self.ids, self.ends
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(both):
            self.tried = min(len(ids_a), len(ids_b))
            return
        last_a, last_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        i, j = int(last_a[-1]) + 1, int(last_b[-1]) + 1
        self._groups(ids_a[:i], ids_b[:j], last_a, last_b)
        ends = np.union1d(ends_a[:i], ends_b[:j])
        linked = ids_a[np.searchsorted(ends_a[:i], ends)] * len(self.lengths[B]) + ids_b[np.searchsorted(ends_b[:j], ends)]
        self.links += len(ends)
        self.pairs.append(np.unique(linked, return_counts=True))
        if len(self.pairs) > 16:
            self.pairs = [self.distinct()]
        self.ids, self.ends, self.tried = [ids_a[i:], ids_b[j:]], [ends_a[i:], ends_b[j:]], 0

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Hash the groups, of which each ends at last_a and last_b: A's ids, then B's."""
        a_more, a_last, b_more, b_last = self.names
        text = np.empty(len(ids_a) + len(ids_b), dtype=object)
        of_a, of_b = a_more[ids_a], b_more[ids_b]
        of_a[last_a], of_b[last_b] = a_last[ids_a[last_a]], b_last[ids_b[last_b]]
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text[np.arange(len(ids_a)) + np.repeat(np.concatenate(([0], last_b[:-1] + 1)), sizes_a)] = of_a
        text[np.arange(len(ids_b)) + np.repeat(last_a + 1, sizes_b)] = of_b
        if self.groups:
            self.hash.update(b";")
        self.hash.update("".join(text.tolist())[:-1].encode())
        self.groups += len(last_a)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        pairs, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        return pairs, np.bincount(at, weights=np.concatenate([n for _, n in self.pairs])).astype(np.int64)


def aligned(blocks: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """For each document of encoded(): numbers of tokens, groups and links, the hash of its groups, its distinct pairs (A's id times B's vocabulary, and B's id) and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = byte_bpe(f"{tokenizers}/{A_FILE}").lengths, piece_bpe(f"{tokenizers}/{B_FILE}").lengths
        names = tuple(np.array([f"{i}{end}" for i in range(len(known))], dtype=object) for known, ends in zip(lengths, (",|", ",;")) for end in ends)

        def documents() -> Iterator[tuple]:
            now = doc = None
            for batch in batches:
                for row, doc_id, at, side, ids in zip(*(c.to_pylist() for c in batch.columns)):
                    if row != now:
                        if doc:
                            yield doc
                        now, doc = row, (row, doc_id, Sweep(lengths, names))
                    if side != NONE:
                        doc[2].take(side, at, np.frombuffer(ids, dtype="<u2").astype(np.int64))
            if doc:
                yield doc

        rows, held = [], 0
        for row, doc_id, swept in documents():
            if not swept.n[A]:
                rows.append((row, doc_id, 0, 0, 0, 0, "", [], []))
            else:
                swept.advance()
                pairs, times = swept.distinct()
                held += len(pairs)
                rows.append((row, doc_id, *swept.n, swept.groups, swept.links, swept.hash.hexdigest(), pairs, times))
            if held > 1_000_000 or len(rows) >= 10_000:
                yield _column(rows, _SWEPT)
                rows, held = [], 0
        if rows:
            yield _column(rows, _SWEPT)

    dealt = blocks.repartition("row").sortWithinPartitions("row", "at", "side")
    return dealt.mapInArrow(run, "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>")


# Counts of pairs -------------------------------------------------------------


def pair_counts(swept: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): the documents that hold a pair, and whether no pair of its A id (pair / width) is held by more. A window has width rows at most."""
    counts = swept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / width)))
    return counts.withColumn("best", F.col("n") == most)


def frequent(counts: DataFrame, head: int = HEAD) -> tuple[int, bool]:
    """(the least power of two that at most head counts reach, whether all do)."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())
    left, k = head, 64
    while k and sizes.get(k - 1, 0) <= left:
        k -= 1
        left -= sizes.get(k, 0)
    return 1 << k, not k


def counted(swept: DataFrame, width: int, head: int = HEAD) -> DataFrame:
    """doc_id, the numbers and the hash of each document of swept (a written table), n_best and count_sum."""
    counts = written(pair_counts(swept, width), "alignment-counts")
    least, whole = frequent(counts, head)
    each = swept.select("row", F.inline(F.arrays_zip("pairs", "times"))).select("row", F.col("pairs").alias("pair"), "times")
    met = each.join(F.broadcast(counts.filter(F.col("n") >= least)), "pair", "inner" if whole else "left")
    if not whole:
        rest = met.filter("n IS NULL").select("row", spread(F.col("pair")).alias("pair"), "times")
        met = met.filter("n IS NOT NULL").unionByName(rest.join(counts.filter(F.col("n") < least), "pair"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = swept.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = written(aligned(encoded(table(spark, sf_dir, "documents"))), "alignment")
    return counted(swept, len(piece_bpe(f"{TOKENIZERS}/{B_FILE}").lengths))
