"""Measures of captured requests against independently derived current text, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.numbers import half_up, nearest_rank, ratio

#: Verdicts of a capture, by precedence.
CAPTURE_REASONS = ("no-capture", "stale", "duplicate", "recall", "pass")


def required_hits(required: DataFrame, payloads: DataFrame, projected: DataFrame) -> DataFrame:
    """required (capture, key, path, gold) with hit: a projected unit (capture, path, sha256) of its path has the text, or the payload holds it."""
    matched = projected.select("capture", "path", F.col("sha256").alias("_sha")).distinct().withColumn("_matched", F.lit(True))
    rows = required.withColumn("_sha", F.sha2("gold", 256)).join(matched, ["capture", "path", "_sha"], "left").join(payloads.select("capture", "payload"), "capture")
    raw = (F.length("gold") > 0) & F.contains("payload", F.col("gold"))
    return rows.withColumn("hit", F.coalesce(F.col("_matched"), F.lit(False)) | raw).drop("_sha", "_matched", "payload")


def recall(hits: DataFrame) -> DataFrame:
    """(capture, required, hits, recall)."""
    n = hits.groupBy("capture").agg(F.count("*").alias("required"), F.count_if("hit").alias("hits"))
    return n.withColumn("recall", F.col("hits") / F.col("required"))


def exact_rate(projected: DataFrame, required: DataFrame) -> DataFrame:
    """(capture, exact, projected, exact_rate): projected units whose text is that of the first required unit of their path."""
    first = required.groupBy("capture", "path").agg(F.min_by("gold", "place").alias("_gold"))
    rows = projected.join(first, ["capture", "path"], "left")
    same = F.coalesce(F.col("sha256") == F.sha2("_gold", 256), F.lit(False))
    out = rows.groupBy("capture").agg(F.count_if(same).alias("exact"), F.count("*").alias("projected"))
    return out.withColumn("exact_rate", ratio(F.col("exact"), F.col("projected")))


def stale(reads: DataFrame, payloads: DataFrame) -> DataFrame:
    """(capture, reads, stale_units, stale_bytes, stale_rate): reads (capture, initial, gold) whose old text the payload still shows."""
    rows = reads.join(payloads.select("capture", "payload"), "capture")
    n = F.when(F.col("initial") != F.col("gold"), text.occurrences(F.col("payload"), F.col("initial"))).otherwise(0)
    out = rows.withColumn("n", n).groupBy("capture").agg(F.count("*").alias("reads"), F.count_if(F.col("n") > 0).alias("stale_units"), F.sum(F.col("n") * F.octet_length("initial")).alias("stale_bytes"))
    return out.withColumn("stale_rate", ratio(F.col("stale_units"), F.col("reads")))


def duplicates(required: DataFrame, payloads: DataFrame) -> DataFrame:
    """(capture, duplicate_units, duplicate_bytes): copies of a required text beyond the first."""
    rows = required.join(payloads.select("capture", "payload"), "capture")
    more = F.greatest(text.occurrences(F.col("payload"), F.col("gold")) - 1, F.lit(0))
    return rows.withColumn("n", more).groupBy("capture").agg(F.sum("n").alias("duplicate_units"), F.sum(F.col("n") * F.octet_length("gold")).alias("duplicate_bytes"))


def sizes(payloads: DataFrame) -> DataFrame:
    """payloads with payload_bytes and projection_bytes; without a projection the payload counts."""
    projection = F.when(F.length("projection") > 0, F.col("projection")).otherwise(F.col("payload"))
    return payloads.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "projection_bytes": F.octet_length(projection).cast("bigint")})


def prefix_reuse(payloads: DataFrame, by: list[str], order: str) -> DataFrame:
    """payloads with reuse: the share of the previous payload's bytes with which this one starts; 1 where there is none."""
    before = F.lag("payload").over(Window.partitionBy(*by).orderBy(order))
    rows = payloads.withColumn("_before", before)
    share = ratio(text.common_prefix_bytes(F.col("_before"), F.col("payload")), F.octet_length("_before"))
    return rows.withColumn("reuse", F.when(F.length("_before") > 0, share).otherwise(F.lit(1.0))).drop("_before")


def changed_bytes(before: Column, after: Column) -> Column:
    """Bytes between the common start and the common end of two texts, the larger side."""
    return text.changed_bytes(before, after)


def delta_amplification(payload_delta: Column, workspace_delta: Column) -> Column:
    return ratio(payload_delta, workspace_delta)


def distribution(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, min, p50, p95, p99, max) of a value, percentiles by nearest rank."""
    p = [nearest_rank(value, q).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)]
    return facts.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), *p, F.max(value).alias("max"))


def determinism(runs: DataFrame, by: list[str], digest: str) -> DataFrame:
    """(by, runs, distinct, agreement, deterministic) of repeated outputs: the share of the commonest digest."""
    each = runs.groupBy(*by, digest).agg(F.count("*").alias("_n"))
    out = each.groupBy(*by).agg(F.sum("_n").alias("runs"), F.count("*").alias("distinct"), F.max("_n").alias("_most"))
    return out.select(*by, "runs", "distinct", (F.col("_most") / F.col("runs")).alias("agreement"), (F.col("distinct") == 1).alias("deterministic"))


def report(facts: DataFrame, by: list[str], rates: list[str], amounts: list[str], latency: str) -> DataFrame:
    """Mean rates, rounded mean amounts, and latency p50 and p95 of each group."""
    return facts.groupBy(*by).agg(
        F.count("*").alias("captures"), *(F.avg(c).alias(c) for c in rates), *(half_up(F.avg(c)).cast("bigint").alias(c) for c in amounts),
        nearest_rank(latency, 0.5).alias("p50"), nearest_rank(latency, 0.95).alias("p95"),
    )


def final_captures(captures: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last capture of each group; a tie goes to the row with the largest values."""
    cols = [c for c in captures.columns if c not in by]
    return captures.groupBy(*by).agg(F.max(F.struct(order, *(c for c in cols if c != order))).alias("c")).select(*by, "c.*")


def gate_failures(captures: DataFrame, prefix: str) -> DataFrame:
    """(system, stale, duplicate, recall): captures of gated systems that break each hard gate."""
    gated = captures.filter(F.startswith("system", F.lit(prefix)))
    return gated.groupBy("system").agg(F.count_if(F.col("stale_units") > 0).alias("stale"), F.count_if(F.col("duplicate_units") > 0).alias("duplicate"), F.count_if(F.col("recall") < 1).alias("recall"))


def best_snapshot(captures: DataFrame, by: list[str]) -> DataFrame:
    """The capture with the best exact rate among those of full recall; the last wins a tie."""
    full = captures.filter("recall = 1")
    return full.groupBy(*by).agg(F.max_by(F.struct("capture", "exact_rate"), F.struct("exact_rate", "place")).alias("s")).select(*by, "s.*")


def judged(captures: DataFrame) -> DataFrame:
    """captures with reason: the first fault, or pass."""
    reason = (
        F.when(F.col("capture").isNull(), "no-capture").when(F.col("stale_units") > 0, "stale").when(F.col("duplicate_units") > 0, "duplicate")
        .when(F.col("recall") < 1, "recall").otherwise("pass")
    )
    return captures.withColumn("reason", reason)


def judged_cells(cells: DataFrame) -> DataFrame:
    """cells with reason: observation, engine, fail-open and content faults by precedence, or pass."""
    reason = (
        F.when(F.col("scope") != "symbol", "observation-not-symbol").when(F.col("spawn").isNull() | (F.col("spawn") == "missing"), "missing-engine")
        .when(F.col("spawn") == "error", "engine-error").when(F.col("fail_open"), "fail-open").when(~F.col("gold_in_payload"), "gold-absent").otherwise("pass")
    )
    return cells.withColumn("reason", reason)


def gold_in_payload(payload: Column, gold: Column) -> Column:
    """Whether a payload holds a text, as it is or inside a JSON string."""
    return F.contains(payload, gold) | F.contains(payload, text.json_escaped(gold))


def redundant_reads(events: DataFrame) -> DataFrame:
    """(trace, reads, redundant, cycles): repeats of a read, and captures."""
    keys = ["trace", "path", "scope", "selector"]
    each = events.filter("type = 'read'").groupBy(*keys).agg(F.count("*").alias("n"))
    reads = each.groupBy("trace").agg(F.sum("n").alias("reads"), F.sum(F.col("n") - 1).alias("redundant"))
    cycles = events.groupBy("trace").agg(F.count_if(F.col("type") == "capture-request").alias("cycles"))
    return cycles.join(reads, "trace", "left").fillna(0, ["reads", "redundant"]).select("trace", "reads", "redundant", "cycles")


def verdict(rows: DataFrame) -> DataFrame:
    """One row: totals of candidate and baseline, the gates, and pass only if all hold and the candidate is smaller."""
    out = rows.agg(
        F.count("*").alias("traces"), F.sum("candidate_bytes").alias("candidate_bytes"), F.sum("baseline_bytes").alias("baseline_bytes"),
        F.sum("required").alias("required"), F.sum("hits").alias("hits"), F.sum("stale_units").alias("stale_units"), F.sum("duplicate_units").alias("duplicate_units"),
    )
    out = out.withColumns({
        "delta": F.col("candidate_bytes") - F.col("baseline_bytes"), "gate_recall": F.col("hits") == F.col("required"), "gate_stale": F.col("stale_units") == 0,
        "gate_duplicate": F.col("duplicate_units") == 0, "gate_captured": F.col("traces") > 0,
    })
    ok = F.col("gate_recall") & F.col("gate_stale") & F.col("gate_duplicate") & F.col("gate_captured") & (F.col("delta") < 0)
    return out.withColumn("verdict", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))


def pack_evaluation(results: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """(repo, selector, candidate_bytes, baseline_bytes, delta) of each case both systems have."""
    both = results.filter(F.col("system").isin(candidate, baseline)).groupBy("repo", "selector").agg(
        F.sum(F.when(F.col("system") == candidate, F.col("bytes"))).alias("candidate_bytes"), F.sum(F.when(F.col("system") == baseline, F.col("bytes"))).alias("baseline_bytes")
    )
    return both.filter("candidate_bytes is not null and baseline_bytes is not null").withColumn("delta", F.col("candidate_bytes") - F.col("baseline_bytes"))


def arm_deltas(facts: DataFrame, case: list[str], arm: str, control: str, values: list[str]) -> DataFrame:
    """facts of other arms with each value's difference from the control's, and missing where there is no control."""
    base = facts.filter(F.col(arm) == control).select(*case, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_has"))
    rows = facts.filter(F.col(arm) != control).join(base, case, "left")
    return rows.select(*case, arm, *((F.col(v) - F.col(f"_{v}")).alias(f"{v}_delta") for v in values), F.col("_has").isNull().alias("missing"))


def tier_deltas(facts: DataFrame, by: list[str], tier: str, value: str) -> DataFrame:
    """facts with to_coarser (difference from the next tier) and to_base (from the coarsest)."""
    order = Window.partitionBy(*by).orderBy(tier)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return facts.withColumns({"to_coarser": F.col(value) - F.lead(value).over(order), "to_base": F.col(value) - F.last(value).over(whole)})


def run_differences(first: DataFrame, second: DataFrame, volatile: list[str]) -> DataFrame:
    """Rows that only one of two runs has, without volatile columns."""
    a, b = (x.drop(*volatile) for x in (first, second))
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, expected, actual) of recorded values (name, value) that differ or are absent."""
    rows = expected.select("name", F.col("value").alias("expected")).join(actual.select("name", F.col("value").alias("actual")), "name", "full_outer")
    return rows.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def normal_stale_rate(stale_bytes: Column, projection_bytes: Column) -> Column:
    """Stale bytes as a share of the projection's."""
    return ratio(stale_bytes, projection_bytes)


def budget_overflow(projection_bytes: Column, budget: Column) -> Column:
    return F.greatest(projection_bytes - budget, F.lit(0))


def recovery_ratio(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(wanted, recovered, ratio) of archived revisions asked for."""
    keys = ["session", "unit_id", "revision"]
    rows = wanted.select(*keys).join(found.select(*keys, F.lit(1).alias("_f")).distinct(), keys, "left")
    return rows.agg(F.count("*").alias("wanted"), F.count("_f").alias("recovered")).withColumn("ratio", ratio(F.col("recovered"), F.col("wanted")))


def pareto(systems: DataFrame, cost: str, gain: str, buckets: int = 32) -> DataFrame:
    """Systems that no other beats in both cost and gain: in order of cost, each that gains more than all cheaper ones.

    Costs are dealt into buckets by approximate percentiles, whose number bounds what reaches
    the driver and what one row's bucket is compared with; each bucket is ordered by itself.
    """
    bounds = systems.agg(F.percentile_approx(cost, [i / buckets for i in range(1, buckets)])).first()[0] or []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(cost))) if bounds else F.lit(0)
    best = systems.groupBy(cost).agg(F.max(gain).alias("_top")).withColumn("_bucket", place)
    tops = best.groupBy("_bucket").agg(F.max("_top").alias("_most"))
    # At most one row a bucket.
    cheaper = tops.select(F.col("_bucket"), F.max("_most").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_below"))
    before = F.max("_top").over(Window.partitionBy("_bucket").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_before", before).join(cheaper, "_bucket").filter(F.coalesce(F.col("_top") > F.greatest("_before", "_below"), F.lit(True)))
    return systems.join(front.select(cost, F.col("_top").alias(gain)), [cost, gain])


def bootstrap_means(deltas: DataFrame, by: list[str], value: str, samples: int = 200, seed: int = 7) -> DataFrame:
    """(by, mean, low, high): 95 % interval of a mean by Poisson resampling, which needs no gathering.

    Each row's weight in a sample comes from a hash of the row's id, so runs agree.
    """
    u = F.pmod(F.xxhash64("id", "b", F.lit(seed)), F.lit(1_000_000)) / 1e6
    # Quantiles of a Poisson distribution of mean 1.
    weight = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    each = deltas.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("w", weight)
    means = each.groupBy(*by, "b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    bounds = means.groupBy(*by).agg(nearest_rank("m", 0.025).alias("low"), nearest_rank("m", 0.975).alias("high"))
    return deltas.groupBy(*by).agg(F.avg(value).alias("mean")).join(bounds, by)
