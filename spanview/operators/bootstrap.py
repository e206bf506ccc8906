"""Intervals of quantiles of paired differences, by resampling pairs; exact for the samples drawn, without gathering.

Each pair's weight in a sample is Poisson, from a hash of the pair and the sample, so runs agree and a pair weighs the same for
all arms. A sample's quantile is the least difference up to which its weights reach their share. All samples are searched at
once in two steps: differences fall into buckets between approximate quantiles, and the samples' weights of a bucket are added
up map-side, which says in which bucket each sample's quantile is and how much weight is left to find there; then only those
buckets are looked at row by row, for the samples that end there, unless all their differences are one. The result does not
depend on the buckets.

Scale: each pair is hashed once a sample, whatever the number of arms. What is shuffled is a row a sample and bucket from each
task, then at most about as many rows as there are differences, fewer where these are equal, added up map-side.

Cases: pairs without either value, or with a null, have no difference. Repeated rows of a pair and arm count by their mean.
Samples in which no pair weighs are none. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import nearest_rank
from ..shared import cut

SAMPLES, BUCKETS, LEVEL = 200, 256, 0.95
#: Upper ends of a uniform number in 2^32 for the counts 0 to 6 of a Poisson distribution of mean 1; above the last it is 7.
_POISSON = tuple(int(2**32 * p) for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676))


def weight(pair: Column, sample: Column, seed: int) -> Column:
    # Eight hexadecimal digits stand in the order of their numbers.
    u = F.substring(F.md5(F.concat_ws(":", pair.cast("string"), sample.cast("string"), F.lit(str(seed)))), 1, 8)
    # Every term is evaluated, so the hash is taken once for all; branches would take it again for each.
    return sum(((u >= f"{end:08x}").cast("int") for end in _POISSON), F.lit(0))


def paired_deltas(facts: DataFrame, base: str) -> DataFrame:
    """(arm, pair, delta): value less that of the arm base for the same pair, of facts (arm, pair, value)."""
    one = facts.filter("arm IS NOT NULL AND pair IS NOT NULL AND value IS NOT NULL").groupBy("arm", "pair").agg(F.avg("value").alias("value"))
    own = one.filter(F.col("arm") == base).select("pair", F.col("value").alias("_base"))
    return one.filter(F.col("arm") != base).join(own, "pair").select("arm", "pair", (F.col("value") - F.col("_base")).alias("delta"))


def quantile_intervals(deltas: DataFrame, quantiles: Sequence[float] = (0.5, 0.95), samples: int = SAMPLES, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(arm, quantile, value, low, high) of deltas (arm, pair, delta): each quantile by nearest rank, with the interval of its samples."""
    deltas = cut(deltas.select("arm", "pair", "delta"), "bootstrap-deltas")
    shares = [i / buckets for i in range(1, buckets)]
    bounds = deltas.groupBy("arm").agg(F.percentile_approx("delta", shares, 10_000).alias("bounds"))
    # A bound is a bucket of its own, so a difference that many pairs have needs no look at its rows.
    place = (2 * F.size(F.filter("bounds", lambda x: x < F.col("delta"))) + F.array_contains("bounds", F.col("delta")).cast("int")).alias("bucket")
    rows = cut(deltas.join(F.broadcast(bounds), "arm").select("arm", "pair", "delta", place), "bootstrap-rows")
    # A pair's weights are hashed once for all arms.
    pairs = rows.groupBy("pair").agg(F.collect_list(F.struct("arm", "bucket")).alias("places"))
    weighed = pairs.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("w", weight(F.col("pair"), F.col("sample"), seed))
    # As a filter, w > 0 would be pushed below w, which would be computed twice.
    sums = weighed.select("sample", "w", F.inline(F.when(F.col("w") > 0, F.col("places")))).groupBy("arm", "sample", "bucket").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("arm", "sample").orderBy("bucket")
    upto = sums.withColumns({"upto": F.sum("w").over(order), "total": F.sum("w").over(Window.partitionBy("arm", "sample"))})
    asked = F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("quantile")
    target = F.ceil(F.round(F.col("quantile") * F.col("total"), 9))
    ends = upto.select("arm", "sample", "bucket", "w", "upto", "total", asked).withColumn("rest", F.greatest(target, F.lit(1)) - (F.col("upto") - F.col("w")))
    ends = ends.filter("total > 0 AND rest > 0 AND rest <= w").select("arm", "sample", "bucket", "quantile", "rest")
    ends = cut(ends, "bootstrap-ends")
    alone = rows.groupBy("arm", "bucket").agg(F.min("delta").alias("value"), F.max("delta").alias("most")).filter("value = most").select("arm", "bucket", "value")
    known = ends.join(alone, ["arm", "bucket"]).select("arm", "sample", "quantile", "value")
    inside = rows.join(ends.join(alone, ["arm", "bucket"], "left_anti"), ["arm", "bucket"]).withColumn("w", weight(F.col("pair"), F.col("sample"), seed)).filter("w > 0")
    inside = inside.groupBy("arm", "sample", "quantile", "rest", "delta").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("arm", "sample", "quantile").orderBy("delta")
    found = inside.withColumn("upto", F.sum("w").over(order)).filter("upto >= rest").groupBy("arm", "sample", "quantile").agg(F.min("delta").alias("value")).unionByName(known)
    tail = round((1 - LEVEL) / 2, 9)
    bars = found.groupBy("arm", "quantile").agg(nearest_rank("value", tail).alias("low"), nearest_rank("value", 1 - tail).alias("high"))
    whole = deltas.groupBy("arm").agg(*(nearest_rank("delta", q).alias(f"q{i}") for i, q in enumerate(quantiles)))
    each = whole.select("arm", F.inline(F.array(*(F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("value")) for i, q in enumerate(quantiles)))))
    return each.join(bars, ["arm", "quantile"], "left")
