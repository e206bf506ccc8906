"""Where paths lead through symbolic links, for whole trees of links as tables.

A path is walked from the root of its workspace: what stands before its first link is as it is, the link is a head that must be
followed, and the rest comes after it. ".." leaves the place that the links before it really lead to, not the one that is
written. Following heads is a pointer that is doubled: a round replaces each head by what that head is known to lead to, be that
a place (then the rest is walked on, up to the next link) or another head with a rest of its own. So chains of n links take about
log2(n) rounds. Once no open path has a head that is known, the open ones lead into circles.

Scale: each round is a join on link paths, of which there is one row each; a link that most paths go through is one hot key
against one row, which Spark splits. Paths are as long as file systems allow, COMPONENTS parts.

Cases: empty parts and "." stay where they are. A path that climbs above the root, or that is absolute and not under root,
escapes. One of more than COMPONENTS parts fails as too-long. A link that is listed twice has its smaller target. A null path or
target fails as missing. Whether a real path is there is not asked. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

COMPONENTS = 2_048
_NO_PARTS = "array<string>"


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))


def _begun(path: Column, base: Column, root: str | None) -> tuple[Column, Column, Column]:
    """(where a walk along path starts, its parts, failure); base is the place that a relative path is seen from."""
    inside = F.startswith(path, F.lit(f"{root.rstrip('/')}/")) if root else F.lit(False)
    absolute = F.startswith(path, F.lit("/"))
    shown = F.when(inside, F.substring(path, F.lit(len(root.rstrip("/")) + 2 if root else 1), F.length(path))).otherwise(path)
    failure = F.when(path.isNull(), "missing").when(absolute & ~inside, "escape")
    return F.when(absolute, F.array().cast(_NO_PARTS)).otherwise(_parts(base)), _parts(shown), failure


def _walked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (key, is_link, done, rest, failure), walked on from done along rest up to the first link, which becomes head."""
    start = F.struct(F.col("done").alias("stack"), F.array().cast(_NO_PARTS).alias("seen"), F.lit(False).alias("out"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        stack = F.when(up, F.slice(state["stack"], F.lit(1), F.greatest(F.size(state["stack"]) - 1, F.lit(0)))).otherwise(F.concat(state["stack"], F.array(part)))
        out = state["out"] | up & (F.size(state["stack"]) == 0)
        # A place above the root is no link's, so that an earlier link is still found.
        return F.struct(stack.alias("stack"), F.concat(state["seen"], F.array(F.when(out | up, F.lit(None)).otherwise(F.array_join(stack, "/")))).alias("seen"), out.alias("out"))

    rows = rows.withColumn("failure", F.when(F.col("failure").isNull() & (F.size("rest") > COMPONENTS), "too-long").otherwise(F.col("failure")))
    going = rows.filter("failure IS NULL").withColumn("walk", F.aggregate("rest", start, step))
    met = going.select("key", "is_link", F.posexplode("walk.seen").alias("at", "place")).filter("place IS NOT NULL")
    met = met.join(links.select(F.col("path").alias("place")), "place").groupBy("key", "is_link").agg(F.min(F.struct("at", "place")).alias("first"))
    on = going.join(met, ["key", "is_link"], "left")
    head = F.col("first.place")
    on = on.select(
        "key", "is_link", head.alias("head"), F.when(head.isNull(), F.col("walk.stack")).alias("done"),
        F.when(head.isNull(), F.array().cast(_NO_PARTS)).otherwise(F.slice("rest", F.col("first.at") + 2, F.size("rest"))).alias("rest"), F.when(head.isNull() & F.col("walk.out"), "escape").alias("failure"),
    )
    return on.unionByName(rows.filter("failure IS NOT NULL").select("key", "is_link", F.lit(None).cast("string").alias("head"), "done", "rest", "failure"))


def resolved(paths: DataFrame, links: DataFrame, root: str | None = None) -> DataFrame:
    """(path, real, failure) of each distinct path of paths (path), all from the workspace's root, with its links (path, target).

    failure is null, escape, loop, too-long or missing; real is null where there is one. Absolute paths count from root, where that is given.
    """
    known = links.select(F.array_join(_parts(F.col("path")), "/").alias("path"), "target").filter("path IS NOT NULL").groupBy("path").agg(F.min("target").alias("target"))
    known = cut(known, "links")
    place = F.regexp_extract(F.col("path"), "^(.*?)/?[^/]*$", 1)
    rows = []
    for is_link, frame, path, base in ((True, known, F.col("target"), place), (False, paths.select("path").distinct(), F.col("path"), F.lit(""))):
        done, rest, failure = _begun(path, base, root)
        rows.append(frame.select(F.col("path").alias("key"), F.lit(is_link).alias("is_link"), done.alias("done"), rest.alias("rest"), failure.alias("failure")))
    now = cut(_walked(rows[0].unionByName(rows[1]), known), "link-paths")
    while True:
        open_ = now.filter("head IS NOT NULL AND failure IS NULL")
        led = now.filter("is_link").select(F.col("key").alias("head"), F.col("head").alias("_head"), F.col("done").alias("_done"), F.col("rest").alias("_rest"), F.col("failure").alias("_failure"))
        ahead = cut(open_.join(led, "head"), "link-heads")
        known_now = F.col("_failure").isNotNull() | F.col("_done").isNotNull()
        if ahead.filter(known_now).isEmpty():
            break
        further = ahead.filter(known_now).select("key", "is_link", F.col("_done").alias("done"), "rest", F.col("_failure").alias("failure"))
        # Two heads become one step; where that would make too long a path, the head waits.
        short = F.size("_rest") + F.size("rest") <= COMPONENTS
        doubled = ahead.filter(~known_now).select(
            "key", "is_link", F.when(short, F.col("_head")).otherwise(F.col("head")).alias("head"), "done", F.when(short, F.concat("_rest", "rest")).otherwise(F.col("rest")).alias("rest"), "failure"
        )
        settled = now.filter("head IS NULL OR failure IS NOT NULL")
        now = cut(settled.unionByName(_walked(further, known)).unionByName(doubled), "link-paths")
    failure = F.coalesce("failure", F.when(F.col("head").isNotNull(), "loop"))
    return now.filter("NOT is_link").select(F.col("key").alias("path"), F.when(failure.isNull(), F.array_join("done", "/")).alias("real"), failure.alias("failure"))


def lexically_safe(path: Column) -> Column:
    """Whether a path stays inside by what is written, links aside."""
    depth = F.aggregate(_parts(path), F.struct(F.lit(0).alias("n"), F.lit(0).alias("least")), lambda s, x: F.struct((s["n"] + F.when(x == "..", -1).otherwise(1)).alias("n"), F.least(s["least"], s["n"] + F.when(x == "..", -1).otherwise(1)).alias("least")))
    return ~F.startswith(path, F.lit("/")) & (depth["least"] >= 0)


def escape_rates(wants: DataFrame) -> DataFrame:
    """(system, unsafe_bytes, included_bytes, rate) of wants (system, failure, bytes, included): bytes outside the root that a system took in, of those that were asked for."""
    unsafe = F.col("failure") == "escape"
    out = wants.groupBy("system").agg(F.sum(F.when(unsafe, F.col("bytes")).otherwise(0)).alias("unsafe_bytes"), F.sum(F.when(unsafe & F.col("included"), F.col("bytes")).otherwise(0)).alias("included_bytes"))
    return out.withColumn("rate", F.col("included_bytes") / F.greatest(F.col("unsafe_bytes"), F.lit(1)))
