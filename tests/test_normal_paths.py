"""Paths that are normal as they stand are not folded; the result is that of the fold."""

import random

from pyspark.sql import functions as F

from spanview import engine
from spanview.functions import ids


def test_as_the_fold(spark):
    r = random.Random(4)
    paths = ["".join(r.choice(["a", "b.py", "/", "/", ".", "..", "\\", " ", "é", "..x", "x.."]) for _ in range(r.randrange(1, 9))) for _ in range(600)] + [".", "..", "/", "a", "a/", "/a", "a/.\n", "a\n", "...", "a/...", "src/f1.py"]
    df = spark.createDataFrame([(p,) for p in paths if p.strip()] + [(None,), ("",), ("  ",)], "p string")
    for x in df.select("p", ids.normal_path(F.col("p")).alias("n")).collect():
        assert x.n == (engine.normal_path(x.p) if x.p and x.p.strip() else None), x.p


def test_a_plain_path_meets_no_fold(spark):
    # The fold is the branch after the guard, which plain paths never reach.
    plan = spark.range(1).select(ids.normal_path(F.concat(F.lit("src/f"), F.col("id").cast("string"))).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and plan.index("RLIKE") < plan.index("aggregate(")
