"""Intervals of paired quantiles against samples drawn one by one, whatever the buckets."""

import hashlib
import math
import random

import pytest

from spanview.operators import bootstrap

POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def weight(pair, sample, seed):
    u = int(hashlib.md5(f"{pair}:{sample}:{seed}".encode()).hexdigest()[:8], 16)
    return next((i for i, p in enumerate(POISSON) if u < int(2**32 * p)), 7)


def rank(values, q):
    values = sorted(values)
    return values[max(0, math.ceil(len(values) * q) - 1)]


def brute(deltas, quantiles, samples, seed):
    out = {}
    for arm in {a for a, _, _ in deltas}:
        own = sorted((d, p) for a, p, d in deltas if a == arm)
        for q in quantiles:
            found = []
            for s in range(1, samples + 1):
                drawn = [d for d, p in own for _ in range(weight(p, s, seed))]
                if drawn:
                    found.append(drawn[max(1, math.ceil(round(q * len(drawn), 9))) - 1])
            out[arm, q] = (rank([d for d, _ in own], q), rank(found, 0.025) if found else None, rank(found, 0.975) if found else None)
    return out


@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_as_samples_drawn_one_by_one(spark, buckets):
    r = random.Random(5)
    deltas = [(a, i, float(r.choice([0, 1, r.randrange(100), r.gauss(0, 30)]))) for a in ("x", "y") for i in range(60)] + [("one", 7, 2.5)]
    got = bootstrap.quantile_intervals(spark.createDataFrame(deltas, "arm string, pair long, delta double"), samples=40, buckets=buckets).collect()
    assert {(x.arm, x.quantile): (x.value, x.low, x.high) for x in got} == brute(deltas, (0.5, 0.95), 40, 7)


def test_pairs(spark):
    facts = [("base", 1, 10.0), ("x", 1, 13.0), ("x", 1, 15.0), ("base", 2, 5.0), ("x", 3, 1.0), ("x", 2, None), ("y", 2, 4.0), (None, 1, 1.0)]
    got = {tuple(x) for x in bootstrap.paired_deltas(spark.createDataFrame(facts, "arm string, pair long, value double"), "base").collect()}
    assert got == {("x", 1, 4.0), ("y", 2, -1.0)}
    empty = spark.createDataFrame([], "arm string, pair long, delta double")
    assert bootstrap.quantile_intervals(empty).count() == 0


def test_a_pair_is_hashed_once_a_sample_and_equal_differences_are_not_looked_at(spark):
    deltas = spark.createDataFrame([(a, i, float(i % 3)) for a in ("x", "y", "z") for i in range(400)], "arm string, pair long, delta double")
    plan = deltas.select(bootstrap.weight(deltas.pair, deltas.pair, 7).alias("w"))._jdf.queryExecution()
    code = plan.debug().codegenToSeq().toString()
    assert code.count("DigestUtils.md5Hex(") == 1
    got = bootstrap.quantile_intervals(deltas, samples=30)
    written = {(x.arm, x.quantile): (x.value, x.low, x.high) for x in got.collect()}
    assert written == brute([(x.arm, x.pair, x.delta) for x in deltas.collect()], (0.5, 0.95), 30, 7)
