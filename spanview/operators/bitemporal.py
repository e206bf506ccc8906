"""Files that several writers change: what was known of them when, late news included.

A write has two times: written, when the file changed, and seen, when the workspace heard of it, which may be much later. Asked
for the state at one time as far as it was known at another, the answer is the latest write of those written and seen by then.
That is a join on two inequalities; here it takes none. The writes of a file are ranked by when they were seen, and each goes
into the nodes of a tree of partial sums over ranks that cover it. A question covers the ranks that it knows by few nodes, and
in a node only the time of writing counts: an as-of join by one union and one window. The best over the nodes is the answer.

Scale: writes and questions each become about half as many rows as a file has bits in its number of writes, at most all of
them. No pair of a write and a question is made. Ranks are windows over one file of one session.

Cases: times may tie; of writes written at one time the one seen later counts, then the larger writer, then the larger seq. A
write without either time, or a question without one, is nowhere. Null sessions are a session. A deletion is content null
and deleted true. Questions about files of which nothing is known give no row. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FILE = ("session", "path")
_WRITE = ("written", "seen", "writer", "seq", "content", "deleted")


def _low_bit(level: Column, rank: Column) -> Column:
    return (F.call_function("shiftright", rank, level) % 2) == 1


def _levels(most: Column) -> Column:
    """0 to the highest bit of a rank."""
    return F.sequence(F.lit(0), F.floor(F.log2(most)).cast("int"))


def _covering(rank: Column, most: Column) -> Column:
    """Nodes, up to most, whose ranks hold rank: a node j stands for as many ranks up to j as its lowest bit says."""
    up = lambda b: F.call_function("shiftleft", F.call_function("shiftright", rank + F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1, b), b)
    nodes = F.transform(_levels(most), lambda b: F.when(_low_bit(b, up(b)) & (up(b) <= most), up(b)))
    return F.array_compact(nodes)


def _covered(rank: Column) -> Column:
    """Nodes that together stand for the ranks 1 to rank."""
    return F.array_compact(F.transform(_levels(rank), lambda b: F.when(_low_bit(b, rank), F.call_function("shiftleft", F.call_function("shiftright", rank, b), b))))


def known(writes: DataFrame, asks: DataFrame) -> DataFrame:
    """(session, ask, path, content, deleted, writer, written, seen) for each of asks (session, ask, at, known_by) and each file of its session that has an answer.

    writes: (session, path, written, seen, writer, seq, content, deleted). at and known_by are of the types of written and seen.
    """
    w = writes.filter(F.col("written").isNotNull() & F.col("seen").isNotNull()).select(*_FILE, *_WRITE)
    kinds = dict(w.dtypes)
    files = w.select(*_FILE).distinct()
    a = asks.filter(F.col("at").isNotNull() & F.col("known_by").isNotNull())
    asked = a.alias("a").join(files.alias("f"), F.col("a.session").eqNullSafe(F.col("f.session"))).select(
        "f.session", "f.path", F.col("a.ask").alias("ask"), F.col("a.at").cast(kinds["written"]).alias("written"), F.col("a.known_by").cast(kinds["seen"]).alias("seen")
    )
    ask_kind = dict(a.dtypes)["ask"]
    both = w.withColumns({"ask": F.lit(None).cast(ask_kind), "asked": F.lit(False)}).unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    # A question ranks as the number of writes seen by its time.
    order = Window.partitionBy(*_FILE).orderBy("seen", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("rank", F.sum((~F.col("asked")).cast("bigint")).over(order)).withColumn("most", F.max("rank").over(Window.partitionBy(*_FILE)))
    nodes = F.when(F.col("asked"), _covered(F.col("rank"))).otherwise(_covering(F.col("rank"), F.col("most")))
    placed = ranked.filter("rank > 0").withColumn("node", F.explode(nodes))
    order = Window.partitionBy(*_FILE, "node").orderBy("written", "asked").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(~F.col("asked"), F.struct(*_WRITE))).over(order)
    best = placed.withColumn("found", last).filter(F.col("asked") & F.col("found").isNotNull()).groupBy(*_FILE, "ask").agg(F.max("found").alias("found"))
    return best.select("session", "ask", "path", "found.content", "found.deleted", "found.writer", "found.written", "found.seen")


def foreign_changes(writes: DataFrame, own: Column) -> DataFrame:
    """writes of others than own that the session's own later write of the file did not know of: written before it and seen after it, with the own write's seq."""
    w = writes.filter(F.col("written").isNotNull() & F.col("seen").isNotNull()).withColumn("_own", F.coalesce(own, F.lit(False)))
    # The next own write after each write, by time of writing.
    order = Window.partitionBy(*_FILE).orderBy(F.desc("written"), F.desc("_own"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    following = F.last(F.when(F.col("_own"), F.struct(F.col("written").alias("at"), F.col("seq").alias("seq"))), ignorenulls=True).over(order)
    out = w.withColumn("_next", following).filter(~F.col("_own") & (F.col("_next.at") >= F.col("written")) & (F.col("seen") > F.col("_next.at")))
    return out.withColumn("lost_to", F.col("_next.seq")).drop("_own", "_next")
