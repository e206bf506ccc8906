"""Partial reads: what each observed of its file, and whole texts put together from parts that overlap.

A read that pages through a file shows a stretch of lines, and may say how many follow. classified() gives what a read stands
for, or why it stands for nothing whole. stitched() lays the parts of a file line by line side by side: a line that two parts
show differently is a conflict, a line that none shows is in a gap, and a file whose end no part saw has an open end. Without
any of these the text is whole.

Scale: parts meet by line, added up map-side, so parts that repeat each other cost a row a line. Gaps are a window over the lines
of one file. Texts are put together only where they are whole, and are as long as the file.

Cases: null content observes nothing. A part without lines to follow and without a count ends the file where it ends. Parts that
claim different ends conflict. Parts that begin before line 1 begin there. Sessions and paths may be null; null is a value of its
own. Repeated parts change nothing. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: how a host ends the text of a read that stops before the end of its file.
MORE_LINES = r"\n\n\[(\d+) more lines in file\. Use offset=\d+ to continue\.\]$"
#: Why a read stands for nothing whole.
TRUNCATED, OPEN_START, PARTIAL = "truncated", "open-start", "partial"
#: Why parts do not make a whole.
CONFLICT, GAP, OPEN_END = "conflict", "gap", "open-end"

_KEYS = ("session", "path")


def _number(value: Column) -> Column:
    """A count from 1, else null."""
    return F.when(value >= 1, value.cast("bigint"))


def classified(reads: DataFrame) -> DataFrame:
    """reads (asked, offset, limit, start_line, end_line, truncated, content) with scope, first_line, last_line, file_lines, issue and body.

    asked is the scope that the call names, or null. body is content without the host's note on further lines; file_lines is
    known where that note and both offset and limit are. issue is why the read is of no whole file, region or symbol.
    """
    offset, limit = _number(F.col("offset")), _number(F.col("limit"))
    both = offset.isNotNull() & limit.isNotNull()
    more = F.when(F.col("content").rlike(MORE_LINES), F.regexp_extract("content", MORE_LINES, 1).try_cast("bigint"))
    named = F.coalesce(F.col("asked").isin("region", "symbol"), F.lit(False))
    cut = F.coalesce(F.col("truncated"), F.lit(False))
    open_start = ~named & both & more.isNull() & (offset > 1)
    partial = ~named & ~both & (F.coalesce(offset > 1, F.lit(False)) | limit.isNotNull() & more.isNotNull())
    issue = F.when(cut, TRUNCATED).when(open_start, OPEN_START).when(partial, PARTIAL)
    paged = ~named & both & (cut | more.isNotNull())
    scope = F.when(named, F.col("asked")).when(paged, "region").otherwise("file")
    region = scope == "region"
    return reads.withColumns({
        "scope": scope,
        "first_line": F.when(region, F.when(paged, offset).otherwise(_number(F.col("start_line")))),
        "last_line": F.when(region, F.when(paged, offset + limit - 1).otherwise(_number(F.col("end_line")))),
        "file_lines": F.when(paged & ~cut & more.isNotNull(), offset - 1 + limit + more),
        "issue": issue,
        "body": F.regexp_replace("content", MORE_LINES, ""),
    })


def as_parts(reads: DataFrame) -> DataFrame:
    """(session, path, first, content, file_lines, ends) of reads (session, path, offset, limit, content): what each shows of its file, whatever it stands for alone."""
    more = F.when(F.col("content").rlike(MORE_LINES), F.regexp_extract("content", MORE_LINES, 1).try_cast("bigint"))
    body = F.regexp_replace("content", MORE_LINES, "")
    first = F.coalesce(_number(F.col("offset")), F.lit(1).cast("bigint"))
    shown = F.size(F.split(body, "\n", -1))
    return reads.select(*_KEYS, first.alias("first"), body.alias("content"), F.when(more.isNotNull(), first - 1 + shown + more).alias("file_lines"), more.isNull().alias("ends"))


def stitched(parts: DataFrame) -> DataFrame:
    """(session, path, text, issue, gaps, parts) of each file of parts (session, path, first, content, file_lines, ends).

    ends: whether a part goes up to the end of its file. gaps are the stretches of lines (first, last) that no part shows; a
    gap up to an end that nobody knows is left open.
    """
    seen = parts.filter(F.col("content").isNotNull()).withColumn("first", F.greatest(F.coalesce("first", F.lit(1)).cast("bigint"), F.lit(1)))
    shown = F.size(F.split("content", "\n", -1))
    end = F.coalesce(F.col("file_lines"), F.when(F.coalesce("ends", F.lit(False)), F.col("first") - 1 + shown)).cast("bigint")
    ends = seen.groupBy(*_KEYS).agg(F.count("*").alias("parts"), F.min(end).alias("end"), F.max(end).alias("_most"))
    lines = seen.select(*_KEYS, "first", F.posexplode(F.split("content", "\n", -1)).alias("i", "line")).withColumn("at", F.col("first") + F.col("i"))
    one = lines.groupBy(*_KEYS, "at").agg(F.min("line").alias("line"), (F.min("line") != F.max("line")).alias("differs"))
    before = F.coalesce(F.lag("at").over(Window.partitionBy(*_KEYS).orderBy("at")), F.lit(0))
    gap = F.when(before + 1 < F.col("at"), F.struct((before + 1).alias("first"), (F.col("at") - 1).alias("last")))
    found = one.withColumn("_gap", gap).groupBy(*_KEYS).agg(
        F.max("differs").alias("differs"), F.max("at").alias("upto"), F.array_sort(F.collect_list("_gap")).alias("gaps"),
    )
    both = ends.alias("a").join(found.alias("b"), _null_safe("a", "b")).select(*(F.col(f"a.{k}").alias(k) for k in _KEYS), "parts", "end", "_most", "differs", "upto", "gaps")
    tail = F.when(F.col("upto") < F.col("end"), F.array(F.struct((F.col("upto") + 1).alias("first"), F.col("end").alias("last"))))
    both = both.withColumn("gaps", F.concat("gaps", F.coalesce(tail, F.array().cast("array<struct<first:bigint,last:bigint>>"))))
    clash = F.col("differs") | F.coalesce(F.col("end") != F.col("_most"), F.lit(False)) | F.coalesce(F.col("upto") > F.col("end"), F.lit(False))
    judged = both.withColumn("issue", F.when(clash, CONFLICT).when(F.size("gaps") > 0, GAP).when(F.col("end").isNull(), OPEN_END))
    whole = judged.filter("issue IS NULL").select(*_KEYS)
    kept = one.alias("a").join(whole.alias("b"), _null_safe("a", "b"), "left_semi")
    texts = kept.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("_lines")).select(*_KEYS, F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("text"))
    out = judged.alias("a").join(texts.alias("b"), _null_safe("a", "b"), "left")
    return out.select(*(F.col(f"a.{k}").alias(k) for k in _KEYS), "text", "issue", "gaps", "parts")


def _null_safe(a: str, b: str) -> Column:
    out = F.lit(True)
    for k in _KEYS:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out
