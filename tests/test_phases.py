"""Phases: computed once, kept while nothing changes, blocked where anything does."""

import pytest
from pyspark.sql import functions as F

from spanview.operators import phases
from spanview.operators.phases import Phase


def rows(df):
    return {x.phase: (x.state, x.reason, x.rows) for x in df.collect()}


def test_phases_of_a_study(spark, tmp_path):
    path, calls = str(tmp_path), []
    docs = spark.createDataFrame([(i, f"text {i}", {"k": str(i)} if i % 2 else None) for i in range(50)], "id long, text string, tags map<string,string>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, good int")

    def freeze(d):
        calls.append("freeze")
        return d.filter("id < 30")

    def generate(f, lab):
        calls.append("generate")
        return f.join(lab, "id")

    def report(g):
        calls.append("report")
        return g.groupBy("good").count()

    study = [Phase("freeze", ("docs",), freeze), Phase("generate", ("freeze", "labels"), generate), Phase("report", ("generate",), report)]
    first = phases.run(spark, study, {"docs": docs, "labels": labels}, path)
    assert rows(first) == {"freeze": ("computed", None, 30), "generate": ("computed", None, 30), "report": ("computed", None, 2)}
    again = phases.run(spark, study, {"docs": docs.repartition(7).orderBy(F.desc("id")), "labels": labels}, path)
    assert rows(again) == {"freeze": ("kept", None, 30), "generate": ("kept", None, 30), "report": ("kept", None, 2)} and calls == ["freeze", "generate", "report"]
    assert {x.phase: x.hash for x in again.collect()} == {x.phase: x.hash for x in first.collect()}
    other = labels.withColumn("good", F.when(F.col("id") == 39, F.lit(None)).otherwise(F.col("good")))
    late = phases.run(spark, study, {"docs": docs, "labels": other}, path)
    assert rows(late) == {"freeze": ("kept", None, 30), "generate": ("blocked", "labels changed", None), "report": ("blocked", "after generate", None)} and len(calls) == 3
    early = phases.run(spark, study, {"docs": docs.unionByName(docs.limit(1)), "labels": labels}, path)
    assert rows(early)["freeze"] == ("blocked", "docs changed", None) and rows(early)["report"][0] == "blocked" and len(calls) == 3
    phases.forget(spark, path, ["generate"])
    anew = phases.run(spark, study, {"docs": docs, "labels": other}, path)
    assert rows(anew) == {"freeze": ("kept", None, 30), "generate": ("computed", None, 30), "report": ("kept", None, 2)}
    assert phases.output(spark, path, "report").count() == 2


def test_failures_and_unread_inputs(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.range(10).withColumnRenamed("id", "n")

    def fails(d):
        return d.withColumn("x", F.raise_error(F.lit("no")))

    with pytest.raises(Exception, match="no"):
        phases.run(spark, [Phase("a", ("docs",), fails)], {"docs": docs}, path)
    ok = phases.run(spark, [Phase("a", ("docs", "more"), lambda d, m: d), Phase("b", ("a",), lambda a: a.limit(0))], {"docs": docs, "more": docs.limit(0)}, path)
    assert rows(ok) == {"a": ("computed", None, 10), "b": ("computed", None, 0)}
    with pytest.raises(ValueError, match="nothing gives"):
        phases.run(spark, [Phase("c", ("unheard",), lambda d: d)], {}, path)
    with pytest.raises(ValueError):
        phases.output(spark, path, "c")


def test_fingerprints_see_any_change(spark):
    base = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5)], "i int, s string, d double")
    same = phases.fingerprint(base)
    assert phases.fingerprint(base.orderBy("s").repartition(3)) == same
    changes = [base.distinct(), base.fillna("x"), base.withColumn("d", F.lit(1.5)), base.select("i", "s"), base.withColumn("e", F.lit(None).cast("int")), base.select("s", "i", "d")]
    assert len({phases.fingerprint(x) for x in changes} | {same}) == 7
