"""Scores, ranks and budgeted selection of units for a task.

The greedy choice skips what doesn't fit and goes on with smaller units, so it is a fold in
rank order and no window. A session is dealt to one task, sorted there and streamed in rank order
with one running total, never collected; a unit is five numbers there, whatever its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..engine import POLICY
from ..functions import text


def task_terms(task: str | Column, content: Column) -> Column:
    """The task's terms that a text has too."""
    return F.array_intersect(text.terms(F.lit(task) if isinstance(task, str) else task), text.terms(content))


def task_overlap(task: str | Column, path: Column, selector: Column, content: Column) -> Column:
    """Number of the task's terms that the unit has too."""
    return F.size(task_terms(task, F.concat(path, F.lit("\n"), F.coalesce(selector, F.lit("")), F.lit("\n"), content)))


def scored(units: DataFrame, task: str, turn: int, budget: int = POLICY["budget_chars"], policy: dict = POLICY) -> DataFrame:
    """units with size (UTF-16 units), overlap and score; unresolved ones score minus infinity."""
    out = units.withColumns({"size": text.utf16_length(F.col("content")), "overlap": task_overlap(task, F.col("path"), F.col("selector"), F.col("content"))})
    return rated(out, turn, budget, policy)


def rated(units: DataFrame, turn: int, budget: int = POLICY["budget_chars"], policy: dict = POLICY) -> DataFrame:
    """units of known size and overlap with their score: their texts are not needed."""
    age = F.greatest(F.lit(turn) - F.col("last_used_at"), F.lit(0))
    recency = F.greatest(F.lit(0.0), 1 - age / F.lit(float(max(1, policy["recency_window"]))))
    score = (
        recency * float(policy["recency_weight"]) + F.col("overlap") * float(policy["overlap_weight"])
        + F.when(F.col("changed_at") == turn, float(policy["changed_weight"])).otherwise(0.0) + F.when(F.col("pinned"), float(policy["pinned_weight"])).otherwise(0.0)
        - F.col("size") / F.lit(float(max(1, budget))) * float(policy["size_weight"])
    )
    return units.withColumn("score", F.when(F.col("state") == "resolved", score).otherwise(F.lit(float("-inf"))))


def forced(turn: int) -> Column:
    """Whether a unit changed in this turn and must be shown whatever the budget."""
    return (F.col("state") == "resolved") & (F.col("change_count") >= 1) & (F.col("changed_at") == turn)


def ranked(units: DataFrame) -> DataFrame:
    """Scored units with their rank in the session: pinned first, then by score, then by id."""
    order = Window.partitionBy("session").orderBy(F.col("pinned").desc(), F.col("score").desc(), F.col("unit_id"))
    return units.withColumn("rank", F.row_number().over(order))


def selected(units: DataFrame, turn: int, budget: int = POLICY["budget_chars"]) -> DataFrame:
    """Scored units with disposition (selected, unresolved or budget) and used, the total after each.

    Changed units are taken first, over budget if need be; then all that fit, in rank order.
    session and unit_id name a unit; units without a session are a session of their own.
    """
    kinds = dict(units.dtypes)
    slim = units.select("session", "unit_id", "size", "score", forced(turn).alias("forced"), "pinned")
    dealt = slim.repartition("session").sortWithinPartitions("session", *(F.col(k).desc() for k in ("forced", "pinned", "score")), "unit_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, used, started = None, 0, False
        for batch in batches:
            cols = {n: batch.column(batch.schema.names.index(n)) for n in ("session", "unit_id", "size", "score", "forced")}
            found, totals = [], []
            for key, size, score, must in zip(*(cols[n].to_pylist() for n in ("session", "size", "score", "forced"))):
                if key != session or not started:
                    session, used, started = key, 0, True
                if score == float("-inf"):
                    kind = "unresolved"
                elif must or not size or used + size <= budget:
                    kind, used = "selected", used + size
                else:
                    kind = "budget"
                found.append(kind)
                totals.append(used)
            yield pa.RecordBatch.from_arrays([cols["session"], cols["unit_id"], pa.array(found, pa.string()), pa.array(totals, pa.int64())], names=["_session", "_unit", "disposition", "used"])

    folded = dealt.mapInArrow(fold, f"_session {kinds['session']}, _unit {kinds['unit_id']}, disposition string, used bigint")
    same = F.col("session").eqNullSafe(F.col("_session")) & F.col("unit_id").eqNullSafe(F.col("_unit"))
    return units.join(folded, same).drop("_session", "_unit")


def dispositions(chosen: DataFrame) -> DataFrame:
    """(session, selected, unresolved, budget, used_chars) of each session."""

    def count(kind: str) -> Column:
        return F.count_if(F.col("disposition") == kind).alias(kind)

    return chosen.groupBy("session").agg(count("selected"), count("unresolved"), count("budget"), F.max("used").alias("used_chars"))


def render_order(chosen: DataFrame) -> DataFrame:
    """Selected units with their place in the projection: what changed least first, so that prompts keep their start."""
    order = Window.partitionBy("session").orderBy("change_count", "unit_id")
    return chosen.filter(F.col("disposition") == "selected").withColumn("place", F.row_number().over(order))


def adapter_budget(env: Column, explicit: Column, tokens: Column, default: int = 32_768) -> Column:
    """Budget in characters: a set one, an asked one, 15 % of the model's tokens within bounds, else the default."""
    derived = F.least(F.lit(32_000), F.greatest(F.lit(4_000), F.floor(tokens * 4 * 0.15)))
    return F.when(env > 0, env).when(explicit > 0, explicit).when(tokens > 0, derived).otherwise(F.lit(default)).cast("bigint")
