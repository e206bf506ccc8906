"""Identities: normal paths, revisions, unit ids and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUL = "\u0000"


def normal_path(path: Column) -> Column:
    """Path with `/` separators and without `.`, empty and resolvable `..` parts; null for a blank one."""
    portable = F.replace(path, F.lit("\\"), F.lit("/"))
    absolute = F.startswith(portable, F.lit("/"))

    def step(acc: Column, part: Column) -> Column:
        skip = (part == "") | (part == ".")
        last = F.element_at(acc, -1)
        can_pop = (F.size(acc) > 0) & (last != "..")
        up = F.when(can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1)).when(absolute, acc).otherwise(F.concat(acc, F.array(part)))
        return F.when(skip, acc).when(part == "..", F.when(F.size(acc) == 0, F.when(absolute, acc).otherwise(F.array(part))).otherwise(up)).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(portable, "/", -1), F.array().cast("array<string>"), step)
    body = F.array_join(parts, "/")
    tail = F.when(F.endswith(portable, F.lit("/")) & (F.size(parts) > 0), "/").otherwise("")
    whole = F.concat(F.when(absolute, "/").otherwise(""), body, tail)
    # Most paths are normal as they stand, without an empty part or one of dots; the others are folded part by part.
    plain = ~F.rlike(portable, F.lit(r"(^|/)\.{0,2}(/|$)"))
    return F.when(F.trim(path) != "", F.when(plain, portable).when(whole == "", ".").otherwise(whole))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column, length: int = 12) -> Column:
    return F.substring(sha256(text), 1, length)


def revision(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256(content))


def span_selector(selector: Column, start: Column, end: Column) -> Column:
    return F.coalesce(selector, F.concat(F.coalesce(start.cast("string"), F.lit("1")), F.lit(":"), F.coalesce(end.cast("string"), F.lit("?"))))


def unit_id(path: Column, scope: Column, selector: Column, start: Column, end: Column) -> Column:
    identity = F.concat(normal_path(path), F.lit(_NUL), F.coalesce(scope, F.lit("region")), F.lit(_NUL), span_selector(selector, start, end))
    return F.concat(F.lit("fc_"), short_hash(identity, 16))


def metric_key(path: Column, scope: Column, selector: Column, start: Column, end: Column) -> Column:
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (selector, start, end)]
    return F.concat(path, F.lit(_NUL), F.coalesce(scope, F.lit("region")), *(x for t in text for x in (F.lit(_NUL), t)))


def observation_key(path: Column, scope: Column, selector: Column, start: Column, end: Column) -> Column:
    """Key under which later reads replace earlier ones; null for a symbol without a selector."""
    span = F.coalesce(selector, F.concat(F.coalesce(start.cast("string"), F.lit("?")), F.lit(":"), F.coalesce(end.cast("string"), F.lit("?"))))
    return (
        F.when(scope == "region", F.concat(F.lit("region:"), path, F.lit(":"), span))
        .when(scope == "symbol", F.when(F.length(selector) > 0, F.concat(F.lit("symbol:"), path, F.lit(":"), selector)))
        .otherwise(F.concat(F.lit("file:"), path))
    )
