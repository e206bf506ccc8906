"""The units that a payload shows, as rows, for each way in which systems write them; inside the JVM.

Framed units carry the length of their content, so text inside a unit may look like a frame. They are read by one pass over the
payload's bytes: from where the last frame ended to the next head, whose length says where it ends. The payload is a string of
its bytes, one character each, on which places and lengths are those of the format. Units under marks run up to the next mark,
blocks up to an empty line.

Scale: a payload is a row and is read where it is; nothing is shuffled. The pass has one step for each head that there is text
for, those inside of units included, and holds places, not text.

Cases: null payloads are empty. A framed payload that does not add up gives one row with its error and no units. Repeated
payloads repeat. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import engine
from ..functions.text import SPACE


def _locate(needle: str, text: Column, at: Column) -> Column:
    """Place of needle in text from a place on, from 1; 0 where it is not."""
    return F.call_function("locate", F.lit(needle), text, at)


def _header(text: Column, head: Column, first: Column) -> Column:
    return F.substring(text, head, first - head)


def _last(header: Column, name: str) -> Column:
    """The value of an attribute that is not part of another's name; the last one where it is there twice."""
    return F.element_at(F.regexp_extract_all(header, F.lit(f'(?<![A-Za-z0-9-]){name}="([^"]*)"'), F.lit(1)), -1)


def _size(header: Column) -> Column:
    """The length in a head, null where it is no number; one that no text has counts as a thousand million."""
    value = F.try_element_at(F.regexp_extract_all(header, F.lit('(?<![A-Za-z0-9-])content-bytes="([^"]*)"'), F.lit(1)), F.lit(-1))
    return F.when(value.rlike("^[0-9]+$"), F.least(F.coalesce(value.try_cast("bigint"), F.lit(10**9)), F.lit(10**9)).cast("int"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scanned(text: Column, tag: str) -> Column:
    """Frames of a text of bytes: where the next one may begin, the error, and each frame's head, content and size."""
    begin, tail = f"<{tag} ", f"\n</{tag}>"

    def new_state(at: Column, error: Column, units: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), error.cast("string").alias("error"), units.alias("units"))

    def judged(state: Column, head: Column, first: Column, size: Column) -> Column:
        last = first + size
        error = (
            F.when(size.isNull(), "invalid content-bytes").when(last - 1 > F.length(text), "truncated unit content")
            .when(F.substring(text, last, F.lit(len(tail))) != tail, "unit length does not meet its closing frame")
        )
        unit = F.struct(head.cast("int").alias("head"), first.cast("int").alias("first"), size.cast("int").alias("size"))
        taken = new_state(last + len(tail), F.lit(None), F.concat(state["units"], F.array(unit)))
        return _let(error, lambda e: F.when(e.isNull(), taken).otherwise(new_state(state["at"], e, state["units"])))

    def step(state: Column, _: Column) -> Column:
        def from_head(head: Column) -> Column:
            def to_content(stop: Column) -> Column:
                first = stop + 2
                ends = _let(_size(_header(text, head, first)), lambda size: judged(state, head, first, size))
                return F.when(stop == 0, new_state(state["at"], F.lit("unterminated unit header"), state["units"])).otherwise(ends)

            return F.when(head == 0, state).otherwise(_let(_locate(">\n", text, head + len(begin)), to_content))

        return F.when(state["error"].isNotNull(), state).otherwise(_let(_locate(begin, text, state["at"]), from_head))

    heads = F.size(F.split(text, begin, -1)) - 1
    start = new_state(F.lit(1), F.lit(None), F.array().cast("array<struct<head:int,first:int,size:int>>"))
    return F.aggregate(F.when(heads > 0, F.sequence(F.lit(1), heads)).otherwise(F.array().cast("array<int>")), start, step)


def _utf8(text: Column) -> Column:
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


def _unescaped(value: Column) -> Column:
    for entity, sign in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(sign))
    return value


def framed(payloads: DataFrame, tag: str = engine.UNIT_TAG) -> DataFrame:
    """payloads (payload, and other columns) as (others, place, id, path, content, bytes, error), by the lengths in the units' heads."""
    others = [f"`{c}`" for c in payloads.columns if c != "payload"]
    text = F.decode(F.encode(F.coalesce("payload", F.lit("")), "UTF-8"), "ISO-8859-1")
    rows = payloads.select(*others, text.alias("_text")).withColumn("_found", _scanned(F.col("_text"), tag))

    def unit(u: Column, i: Column) -> Column:
        header = _header(F.col("_text"), u["head"], u["first"])
        named = [F.when(F.contains(header, F.lit(f'{n}="')), _unescaped(_utf8(_last(header, n)))).alias(n) for n in ("id", "path")]
        return F.struct(i.alias("place"), *named, _utf8(F.substring(F.col("_text"), u["first"], u["size"])).alias("content"), u["size"].cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("error"))

    failed = F.array(F.struct(F.lit(0).alias("place"), *(F.lit(None).cast("string").alias(n) for n in ("id", "path", "content")), F.lit(None).cast("bigint").alias("bytes"), F.col("_found.error").alias("error")))
    return rows.select(*others, F.inline(F.when(F.col("_found.error").isNotNull(), failed).otherwise(F.transform("_found.units", unit))))


def _trimmed_end(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+$", "")


def marked(payloads: DataFrame, mark: str = "whole-file", ends: str = "sync:") -> DataFrame:
    """Units that follow a mark with their path and end at the next mark or line of synchronisation; white space at their end goes."""
    others = [f"`{c}`" for c in payloads.columns if c != "payload"]
    pattern = f'\\[{mark} path="([^"]+)"\\]\\n?'
    text = F.coalesce("payload", F.lit(""))
    paths, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)

    def unit(path: Column, i: Column) -> Column:
        part = F.get(parts, i + 1)
        at = F.call_function("instr", part, F.lit(f"\n{ends}"))
        content = _trimmed_end(F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part))
        return F.struct(i.alias("place"), F.concat(F.lit("file:"), path).alias("id"), path.alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("error"))

    return payloads.select(*others, F.inline(F.transform(paths, unit)))


def blocks(payloads: DataFrame, leave_out: tuple[str, ...] = (r"^TASK:", r"^\[span:", r"<span-")) -> DataFrame:
    """Units that are blocks between empty lines, but for tasks, marks and frames; their id is the start of their hash."""
    others = [f"`{c}`" for c in payloads.columns if c != "payload"]
    kept = F.filter(F.split(F.coalesce("payload", F.lit("")), "\n\n", -1), lambda b: ~b.rlike(f"^[{SPACE}]*$") & ~b.rlike("|".join(leave_out)))
    unit = F.transform(kept, lambda b, i: F.struct(i.alias("place"), F.substring(F.sha2(b, 256), 1, 16).alias("id"), F.lit(None).cast("string").alias("path"), b.alias("content"), F.octet_length(b).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("error")))
    return payloads.select(*others, F.inline(unit))


def units(payloads: DataFrame) -> DataFrame:
    """Units of payloads (system, payload, ...) by the way in which each system writes: by unit, whole file, what was read; others show none."""
    framed_ = framed(payloads.filter(F.startswith("system", F.lit("unit-"))))
    return framed_.unionByName(marked(payloads.filter("system = 'whole-file'"))).unionByName(blocks(payloads.filter("system = 'append-only'")))
