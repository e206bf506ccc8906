"""Token ids of documents, packed into rows of fixed length.

Texts become ids of a public byte-level vocabulary, each document with an end mark. What is
longer than a row is cut into full rows and a rest, with nothing lost; the rests are packed
best-fit-decreasing: the longest first, each into the row with the least free space that
holds it, found by a segment tree over free capacities.

Every row is a line of an id matrix, as little-endian bytes: ids, then padding. cu_seqlens
has the cumulative lengths of its segments from 0, and resets the places at which position
ids start from 0 again. segments names each segment's document, its first token in the
document and its length.

write_matrices() puts the rows into files of fixed-size records, which numpy maps as they are
(record_type()), with a table of the lengths, resets and segments beside them, and
read_matrices() reads both back.

Scale: nothing is shuffled. A task packs windows of WINDOW_TOKENS of its own partition, so
its memory is bounded, and a lost task packs the same rows again. Rows are not carried from
one window into the next; a window is some thousand rows, so that few of them have space
left. Files of records have FILE_BYTES at most.

Cases: null and empty texts are an end mark alone. Texts are encoded whole, however long, runs of millions of spaces, letters or signs too (tokens.py).
Ties of length go to the earlier document, ties of free space to the row opened last.
Repeated rows are packed again; rows without doc_id have a null in segments. An empty table
gives no rows, and files without records. Other columns are not read, whatever their names.
Every machine must have the vocabulary file under the path that is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import TOKENIZERS, ByteBPE, byte_bpe

VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50_256
LENGTH, WINDOW_TOKENS, FILE_BYTES = 2_048, 2_000_000, 64_000_000

SCHEMA = (
    "shard int, row bigint, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>,"
    " segments array<struct<doc_id: bigint, first: bigint, n: int>>"
)
_ARROW = pa.schema([
    ("shard", pa.int32()), ("row", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
    ("segments", pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int32())]))),
])


class CapacityTree:
    """Open bins by free capacity; finds the least capacity that is enough in a logarithm of steps."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def push(self, capacity: int, bin_: int) -> None:
        self.bins.setdefault(capacity, []).append(bin_)
        self._add(capacity, 1)

    def pop(self, needed: int) -> tuple[int, int] | None:
        """(capacity, bin) of a bin with the least capacity that is at least needed."""
        i = needed + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Indexes of lengths (1 to most) by bin of capacity most."""
    tree, bins = CapacityTree(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop(lengths[i])
        if found is None:
            found = most, len(bins)
            bins.append([])
        bins[found[1]].append(i)
        if found[0] > lengths[i]:
            tree.push(found[0] - lengths[i], found[1])
    return bins


def tokens(text: str | None, known: ByteBPE) -> np.ndarray:
    """Ids of the whole text and the end mark."""
    return np.append(known.encode(text or ""), np.array([END], dtype="<u2"))


def _row(shard: int, number: int, parts: list[tuple], length: int) -> dict:
    ids = np.full(length, END, dtype="<u2")
    at, cu = 0, [0]
    for _, _, piece in parts:
        ids[at : at + len(piece)] = piece
        at += len(piece)
        cu.append(at)
    return {"shard": shard, "row": number, "ids": ids.tobytes(), "n_tokens": at, "cu_seqlens": cu, "resets": cu[:-1], "segments": [{"doc_id": d, "first": f, "n": len(p)} for d, f, p in parts]}


def pack(docs: Iterator[tuple[int | None, np.ndarray]], length: int = LENGTH, window: int = WINDOW_TOKENS, shard: int = 0) -> Iterator[dict]:
    """Rows of the documents' ids, window by window."""
    rests: list[tuple] = []
    held = number = 0
    for doc_id, ids in docs:
        whole = len(ids) // length * length
        for first in range(0, whole, length):
            yield _row(shard, number, [(doc_id, first, ids[first : first + length])], length)
            number += 1
        if len(ids) > whole:
            rests.append((doc_id, whole, ids[whole:]))
            held += len(ids) - whole
        if held >= window:
            for bin_ in best_fit_decreasing([len(x[2]) for x in rests], length):
                yield _row(shard, number, [rests[i] for i in bin_], length)
                number += 1
            rests, held = [], 0
    for bin_ in best_fit_decreasing([len(x[2]) for x in rests], length):
        yield _row(shard, number, [rests[i] for i in bin_], length)
        number += 1


def packed(docs: DataFrame, length: int = LENGTH, tokenizers: str = TOKENIZERS, window: int = WINDOW_TOKENS) -> DataFrame:
    """Packed rows of docs (doc_id, text); shard and row together name a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = byte_bpe(f"{tokenizers}/{VOCABULARY}"), TaskContext.get().partitionId()

        def ids() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    yield doc_id.as_py(), tokens(text.as_py(), known)

        rows: list[dict] = []
        for row in pack(ids(), length, window, shard):
            rows.append(row)
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def record_type(length: int = LENGTH) -> np.dtype:
    """One record of the files: a row of the id matrix, its name and a line end."""
    return np.dtype([("shard", ">i4"), ("row", ">i8"), ("ids", "<u2", (length,)), ("end", "S1")])


def write_matrices(rows: DataFrame, path: str, length: int = LENGTH) -> None:
    """Packed rows (a written table, as it is read twice) as records under path/ids, and all else of them under path/index."""

    def big_endian(name: str, digits: int) -> Column:
        return F.unhex(F.lpad(F.hex(F.col(name).cast("bigint")), digits, "0"))

    line = F.concat(big_endian("shard", 8), big_endian("row", 16), F.col("ids"))
    lines = rows.select(line.cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, FILE_BYTES // record_type(length).itemsize)).text(f"{path}/ids")
    rows.drop("ids").write.parquet(f"{path}/index")


def read_matrices(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """The packed rows under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records = np.frombuffer(content.as_py(), dtype=record_type(length))
                if not (records["end"] == b"\n").all():
                    raise ValueError(f"not records of {length} ids")
                for i in range(0, len(records), 256):
                    part = records[i : i + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["shard"].astype(np.int32)), pa.array(part["row"].astype(np.int64)), pa.array([x.tobytes() for x in part["ids"]], pa.binary())], names=["shard", "row", "ids"]
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("content")
    ids = files.mapInArrow(run, "shard int, row bigint, ids binary")
    return ids.join(spark.read.schema(SCHEMA).parquet(f"{path}/index").drop("ids"), ["shard", "row"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of the mix."""
    return packed(docs)
