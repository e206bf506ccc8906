"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix has as many words as the documents. Sources have weights; a source's target is its
weighted share, at most REPEATS times its own size, and what that leaves over goes to the
others by weight until none is above. Blocks of BLOCK_WORDS words are allocated to the
sources by highest quotients target / (2 k + 1), and a source's blocks to its shards by
highest quotients of the shards' sizes, which gives integer quotas per shard. In a shard,
the documents lie one after another in the order of a seeded hash; whole turns are
repeats, and the rest is a run of blocks that starts at a seeded block. A document takes
the words of it that lie in selected blocks, so cuts fall inside two documents a shard at most.

Scale: the texts are counted once for the query; (source, hash, size) is written and all else
comes from it. The stage reads them a second time and deals out each row once. Every source has shards
of its own, about SHARD_WORDS words or SHARD_ROWS rows each, so that a hot source is many tasks and a
small one is one. Sources stay in a table of one row each: targets and quotients come from
sums over it, and no more than those sums reaches the driver. The tables of sources and shards
are joined by Spark, which broadcasts them only below its own threshold. One task holds one
number for each shard of a source.

Cases: null, empty and blank texts have size 0 and take 0. Sources come by code point, null
last as a source of its own; weights repeat 1, 2, 3. With all sizes 0, targets are 0. Rows
without doc_id are mixed like others, told apart by their texts. Ties of quotients go to the
earlier source or shard, ties of the hash to the smaller doc_id, then size; rows that tie in all
are alike. Empty tables give empty results. Other columns pass through, whatever their names;
columns named size, source_size, target, taken or turns are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, table, written

WEIGHTS, REPEATS, BLOCK_WORDS, SEED = (1, 2, 3), 3, 32, 11
#: Words and rows of a shard, about.
SHARD_WORDS, SHARD_ROWS = 1_000_000, 100_000
#: Quotients that one pass over the sources looks at.
AT_ONCE = 256

RESULTS = ("size", "source_size", "target", "taken", "turns")

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sainte_lague(shares: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients share / (2 k + 1), none beyond its cap; the earlier wins a tie.

    Bisection finds the quotient to which all seats but at most one or so each are given;
    those left are given one by one.
    """
    shares, caps = np.asarray(shares, dtype=np.float64), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, caps[shares > 0].sum())) if len(shares) else 0
    out = np.zeros(len(shares), dtype=np.int64)
    if seats <= 0:
        return out

    def given(quotient: float) -> np.ndarray:
        return np.minimum(caps, np.floor((np.minimum(shares / quotient, 1e17) + 1) / 2).astype(np.int64))

    low, high = 0.0, float(shares.max()) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    for _ in range(seats - int(out.sum())):
        out[int(np.argmax(np.where(out < caps, shares / (2 * out + 1), -1.0)))] += 1
    return out


def measured(docs: DataFrame, seed: int = SEED, without: tuple[str, ...] = RESULTS) -> tuple[DataFrame, list[Column]]:
    """docs by column numbers with source, doc, size and hash; and the columns to select for the old names."""
    return numbered(docs, without, source=F.col("source"), doc=F.col("doc_id"), size=word_count(F.col("text")), hash=F.xxhash64("doc_id", "text", F.lit(seed)))


def ordered(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sums with place (0 for the first source by code point, null last) and weight; written."""
    rows = written(sums.orderBy(F.col("source").isNull(), "source").withColumn("_id", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("_id", 33)
    # One number a partition: how many sources lie before it.
    counts = {int(p): n for p, n in rows.groupBy(part.alias("p")).count().collect()}
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    first = F.create_map(*(F.lit(x) for p in before.items() for x in p))[part] if before else F.lit(0)
    place = (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + first).cast("bigint")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return rows.withColumn("place", place).withColumn("weight", weight).drop("_id")


def with_targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sources (source_size, weight) with target: the words wanted of each."""
    most, own = F.col("source_size") * repeats, F.col("source_size")
    size, weight = sources.agg(F.coalesce(F.sum(own), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, total, above = size, weight, 0
    while total:
        # What a unit of weight gets only rises from round to round, so that sources once above stay there.
        is_above = F.lit(float(left)) * F.col("weight") / F.lit(total) > most
        held, rest, n = sources.agg(F.coalesce(F.sum(F.when(is_above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~is_above, F.col("weight"))), F.lit(0.0)), F.count(F.when(is_above, 1))).first()
        if n == above:
            return sources.withColumn("target", F.when(is_above, most.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(total)))
        left, total, above = size - held, rest, n
    return sources.withColumn("target", most.cast("double"))


def with_blocks(sources: DataFrame, seats: int, cap: Column) -> DataFrame:
    """sources (place, target) with blocks: their seats by highest quotients target / (2 k + 1), none beyond its cap; the earlier wins a tie.

    Passes over the sources look at AT_ONCE quotients each, until the last one that gives no more than all seats is known.
    """
    share, cap = F.col("target"), F.when(F.col("target") > 0, cap).otherwise(F.lit(0)).cast("bigint")

    def given(quotient: Column) -> Column:
        return F.least(cap, F.floor((F.least(share / quotient, F.lit(1e17)) + 1) / 2).cast("bigint"))

    held, top = sources.agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.max(share), F.lit(0.0))).first()
    seats, low, high, taken = int(min(seats, held)), 0.0, 2.0 * top, 0
    if seats <= 0:
        return sources.withColumn("blocks", F.lit(0).cast("bigint"))
    while taken < seats:
        between = sorted({x for x in np.linspace(low, high, AT_ONCE + 2)[1:-1].tolist() if low < x < high})
        if not between:
            break
        tried = sources.withColumn("q", F.explode(F.array(*map(F.lit, between)))).groupBy("q").agg(F.sum(given(F.col("q"))).alias("n"))
        sums = {r.q: r.n for r in tried.collect()}
        enough = [q for q in between if sums[q] <= seats]
        if enough:
            high, taken = enough[0], sums[enough[0]]
        low = max((q for q in between if sums[q] > seats), default=low)
    out = sources.withColumn("blocks", given(F.lit(high)))
    if taken == seats:
        return out
    # Quotients that tie at the last place: the earlier sources have the seats that are left.
    tied = out.filter((F.col("blocks") < cap) & (share / (2 * F.col("blocks") + 1) >= F.lit(low)))
    last = tied.select("place", F.row_number().over(Window.orderBy(F.desc(share / (2 * F.col("blocks") + 1)), "place")).alias("r")).filter(F.col("r") <= seats - taken)
    out = written(out, "mix-quotas").join(last.select("place", F.lit(1).alias("_more")), "place", "left")
    return out.withColumn("blocks", F.col("blocks") + F.coalesce("_more", F.lit(0))).drop("_more")


def quotas(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS) -> DataFrame:
    """(source, place, source_size, target, blocks, shards), one row a source, written."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = with_targets(ordered(sums, weights))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    found = with_blocks(sources, round(total / block), F.ceil(F.col("source_size") * REPEATS / block))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n") / SHARD_ROWS)).cast("bigint")
    return written(found.select("source", "place", "source_size", "target", "blocks", shards.alias("shards")), "mix-sources")


def _of_shards(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        stock = pdf["stock"].to_numpy()
        got = sainte_lague(stock, int(pdf["blocks"].iloc[0]), -(-REPEATS * stock // block))
        return pdf.assign(quota=got)[["place", "shard", "stock", "quota"]]

    return run


def mix(rows: DataFrame, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """rows (source, doc, size, hash) with source_size, target, turns (the word ranges that a row takes, as array<struct<first, n>>) and taken.

    sizes has the same (source, size, hash), from a table that is cheap to read.
    """
    sources = quotas(sizes, weights, block)

    def sharded(df: DataFrame) -> DataFrame:
        its = sources.select(F.col("source").alias("_of"), "place", "source_size", "target", "blocks", "shards")
        return df.join(its, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("shard", F.pmod("hash", "shards"))

    each = sharded(sizes).groupBy("place", "shard").agg(F.sum("size").alias("stock"), F.first("blocks").alias("blocks"))
    plan = written(each.groupBy("place").applyInPandas(_of_shards(block), "place bigint, shard bigint, stock bigint, quota bigint"), "mix-shards")

    # The rows are dealt out by shard once: for their order, and for the join with the shards' quotas.
    order = Window.partitionBy("place", "shard").orderBy("hash", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sharded(rows).drop("blocks", "shards").withColumn("_at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(plan, ["place", "shard"])
    words = F.least(F.col("quota") * block, F.col("stock") * REPEATS)
    stock = F.greatest("stock", F.lit(1))
    placed = placed.withColumn("_full", F.floor(words / stock)).withColumn("_rest", words - F.col("_full") * stock)
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.greatest(F.ceil(stock / block), F.lit(1))) * block
    placed = placed.withColumn("_start", F.least(start, stock - 1)).withColumn("_end", F.col("_start") + F.col("_rest"))

    def part(lo: Column, hi: Column) -> Column:
        """Range of the document's words that lie in [lo, hi) of the shard."""
        first = F.greatest(lo - F.col("_at"), F.lit(0))
        n = F.least(hi - F.col("_at"), F.col("size")) - first
        return F.struct(first.cast("bigint").alias("first"), F.greatest(n, F.lit(0)).cast("bigint").alias("n"))

    turns = F.concat(
        F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("size").alias("n")), F.col("_full").cast("int")),
        F.array(part(F.lit(0), F.col("_end") - stock), part(F.col("_start"), F.least("_end", stock))),
    )
    placed = placed.withColumn("turns", F.filter(turns, lambda t: t["n"] > 0))
    return placed.withColumn("taken", F.aggregate("turns", F.lit(0).cast("bigint"), lambda acc, t: acc + t["n"]))


def _sizes(rows: DataFrame) -> DataFrame:
    return written(rows.select("source", "doc", "size", "hash"), "mix-sizes")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, taken and turns."""
    rows, back = measured(docs, seed)
    return mix(rows, _sizes(rows), weights, block, seed).select(*back, *RESULTS)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))[0])
    return mix(sizes, sizes).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each turn of a document; turns of some of its words have the text of those words."""
    rows, back = measured(docs, without=())
    old = {name.lower(): F.col(f"_c{i}") for i, name in enumerate(docs.columns)}
    each = mix(rows, _sizes(rows)).withColumn("_t", F.explode("turns"))
    some = F.array_join(F.slice(F.regexp_extract_all(old["text"], F.lit(WORD), F.lit(0)), (F.col("_t.first") + 1).cast("int"), F.col("_t.n").cast("int")), " ")
    each = each.withColumn("text", F.when(F.col("_t.n") == F.col("size"), old["text"]).otherwise(some))
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    return each.select(*(made[name.lower()].cast(dict(docs.dtypes)[name]).alias(name) if name.lower() in made else c for name, c in zip(docs.columns, back)))
