"""Groups of spelling variants: words one edit apart, each with the much more frequent form it stands for.

Two words are near if they differ by one inserted, deleted or replaced code point. One edit leaves a half intact: with m the
length of the shorter word and p the length of the common start, the words share their first half where p is in the second,
and their last half where it is in the first. So near words are neighbours in a block of equal starts of the sorted
dictionary, or in a block of equal ends of the dictionary of reversed words. Both are dealt out by ranges of blocks, sorted,
and scanned. A block (m, low, high) is responsible for the pairs with low <= p <= high: its words share low code points in
front and m - 1 - high at the end. A pair has one p, so no pair is found twice.

A block of over BLOCK words is cut at the middle of low to high into two smaller ones, of which one has more in front in
common and one more at the end, until no block is over BLOCK or nothing is left to cut (low = high: all but one place is the
same, so the alphabet bounds the block). Inside a task the same cut goes on down to PAIRED words, which are compared.

Scale: texts are read once and counted map-side; from there on distinct words move, in a few rows each. Blocks bound what a
task holds; only verified pairs leave it. Forms lead from word to word with n growing at least RATIO times at each step, so
chains are short, and doubling the step finds their ends in a few joins.

Cases: null and empty texts have no words. Rows without doc_id hash as if it were empty. Repeated rows count again. Ties for
the form go to the smaller word in code-point order. Runs are whole, however long; a word of a million letters is a word.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, table, written

RUN = "[A-Za-zÀ-ÿ]+"
#: A run whose hash this number divides loses a code point; words are of so many code points and occurrences at least.
DAMAGE, LENGTH, OCCURRENCES = 199, 6, 5
#: How many times as frequent as a word its form is at least.
RATIO = 5
#: Words of a block that a task takes, and of one that it compares pair by pair.
BLOCK, PAIRED = 512, 8

_NODE = ("m", "low", "high", "head", "tail")
_PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])


def words(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of docs (doc_id, text), runs that are to be damaged damaged."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= length).withColumn("run", ascii_lower(F.col("run")))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def _node(rows: DataFrame, ranges: Column) -> DataFrame:
    """Rows (word, n, m) once for each (low, high) of ranges, with what the words of its block share in front and, read backwards, at the end."""
    each = rows.select("word", "n", "m", F.explode(ranges).alias("r")).select("word", "n", "m", "r.low", "r.high")
    back = F.greatest(F.lit(0), F.col("m") - 1 - F.col("high"))
    return each.select(*_NODE[:3], F.substring("word", F.lit(1), F.col("low")).alias("head"), F.substring(F.reverse("word"), F.lit(1), back).alias("tail"), "word", "n")


def _halves(low: Column, high: Column) -> Column:
    mid = F.floor((low + high + 1) / 2).cast("int")
    return F.array(F.struct(mid.alias("low"), high.alias("high")), F.struct(low.alias("low"), (mid - 1).alias("high")))


def blocks(known: DataFrame, limit: int = BLOCK) -> list[DataFrame]:
    """Frames (m, low, high, head, tail, word, n) whose blocks have limit words at most, or cannot be cut.

    known (a written table) has each word once. A word stands in blocks for pairs with its equals and with longer words
    (m its length), and for those with shorter ones (m its length less one).
    """
    size = F.length("word")
    rows = known.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    rows, out = _node(rows, _halves(F.lit(0), F.col("m"))), []
    while True:
        big = written(rows.groupBy(*_NODE).count().filter(f"count > {limit} AND low < high").select(*_NODE), "spelling-blocks")
        if big.isEmpty():
            return [*out, rows]
        out.append(rows.join(big, list(_NODE), "left_anti").select(*rows.columns))
        held = written(rows.join(big, list(_NODE), "left_semi"), "spelling-held")
        rows = _node(held, _halves(F.col("low"), F.col("high")))


def near_pairs(block: list[tuple[str, int]], m: int, low: int, high: int, paired: int = PAIRED) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs of a block whose common start has low to high code points, the shorter word (m long) first."""
    waiting = [(block, low, high)]
    while waiting:
        held, low, high = waiting.pop()
        if len(held) > paired and low < high:
            mid = (low + high + 1) // 2
            for a, b in ((mid, high), (low, mid - 1)):
                # What follows the last place that may differ is one longer in the longer words.
                back = max(0, m - 1 - b)
                parts: dict[tuple[str, str], list] = {}
                for w in held:
                    parts.setdefault((w[0][:a], w[0][len(w[0]) - back :]), []).append(w)
                waiting += [(part, a, b) for part in parts.values() if len(part) > 1]
            continue
        for i, (u, n) in enumerate(held):
            if len(u) != m:
                continue
            for j, (v, k) in enumerate(held):
                same = len(v) == m
                if same and j <= i:
                    continue
                p = low
                while p < m and u[p] == v[p]:
                    p += 1
                if p <= high and (p < m and u[p + 1 :] == v[p + 1 :] if same else u[p:] == v[p + 1 :]):
                    yield u, n, v, k


def _scanned(batches: Iterator[pa.RecordBatch], paired: int) -> Iterator[pa.RecordBatch]:
    """Both directions of the near pairs of each block; blocks are contiguous and in order."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple] = []
    for (m, low, high, _, _), block in groupby(rows(), itemgetter(0, 1, 2, 3, 4)):
        for u, n, v, k in near_pairs([x[5:] for x in block], m, low, high, paired):
            out += [(u, n, v, k), (v, k, u, n)]
        if len(out) >= 16_384:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PAIRS.types)], schema=_PAIRS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PAIRS.types)], schema=_PAIRS)


def near(known: DataFrame, limit: int = BLOCK, paired: int = PAIRED) -> DataFrame:
    """(word, n, other, other_n) for each word of known (a written table) and each word near it."""
    out = None
    for rows in blocks(known, limit):
        dealt = rows.repartitionByRange(*_NODE).sortWithinPartitions(*_NODE, "word")
        found = dealt.mapInArrow(lambda it: _scanned(it, paired), "word string, n bigint, other string, other_n bigint")
        out = found if out is None else out.unionByName(found)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the end of the chain of forms. Each round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.filter("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(further, "root", "left")
        after = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        dropped(now)
        now = after
    return now.select("word", "root")


def grouped(known: DataFrame, ratio: int = RATIO, limit: int = BLOCK, paired: int = PAIRED) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of known (word, n), which has each word once."""
    known = written(known.select("word", F.col("n").cast("bigint").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    seen = near(known, limit, paired).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"), best)
    stands = -F.col("best.n") >= ratio * F.col("own")
    seen = written(seen.select("word", "n_near", F.when(stands, F.col("best.word")).alias("form"), F.when(stands, -F.col("best.n")).alias("form_n")), "spelling-near")
    ends = roots(seen.filter("form IS NOT NULL").select("word", "form"))
    out = known.join(seen, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def spelling_sql() -> str:
    """The same in DuckDB SQL: CRC-32 by its table, near words by what is left of them without one code point."""
    crc_table = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    data = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + CAST(unicode(x) // 64 AS BIGINT), 128 + CAST(unicode(x) % 64 AS BIGINT)] END))"
    return f"""WITH RECURSIVE t AS (SELECT {crc_table} AS t),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS BIGINT)])), 4294967295) AS h FROM runs, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS k FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.rest = w.word),
s AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY k DESC, other) AS o, max(k) AS k FROM p GROUP BY word, n),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN k >= 5 * w.n THEN o END AS form, CASE WHEN k >= 5 * w.n THEN k END AS form_n FROM w LEFT JOIN s ON s.word = w.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT r.root FROM r JOIN f g ON g.word = r.root WHERE r.word = f.word AND g.form IS NULL) AS root, n, n_near, form_n FROM f"""
