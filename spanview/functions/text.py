"""Text as lines, terms and bytes.

Offsets and sizes come in three units: code points (Spark's length), UTF-8 bytes
(octet_length) and UTF-16 units, which budgets count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as an ECMAScript regular expression has it, as a Java character class body.
SPACE = r"\s\x0B\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
TERM = r"[a-z_][a-z0-9_]{2,}"


def unix_lines(text: Column) -> Column:
    """CRLF becomes LF."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def lines(text: Column) -> Column:
    """Lines of a text, a last empty one included."""
    return F.split(unix_lines(text), "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def normal_line(line: Column) -> Column:
    """A line without outer white space, runs of it inside as one space."""
    inner = F.regexp_replace(line, f"[{SPACE}]+", " ")
    return F.regexp_replace(inner, "^ | $", "")


def normal_lines(text: Column) -> Column:
    return F.transform(lines(text), normal_line)


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1, both included; what lies outside is absent."""
    n = F.greatest(F.least(last, line_count(text)) - first + 1, F.lit(0))
    return F.array_join(F.slice(lines(text), F.greatest(first, F.lit(1)), n), "\n")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def occurrences(text: Column, needle: Column) -> Column:
    """Number of non-overlapping places of needle in text, from the left; 0 for an empty needle."""
    found = (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)
    return F.when(F.length(needle) > 0, found.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def terms(text: Column) -> Column:
    """Distinct identifier-like terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def line_of_offset(text: Column, offset: Column) -> Column:
    """Line number, from 1, of the character at offset, from 1."""
    return F.size(F.split(F.substring(text, F.lit(1), offset - 1), "\n", -1))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _most(size: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The largest n up to size for which same(m, n) holds of all parts m to n: by bisection, and what is known to be the same is not compared again."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        return bound(F.struct(mid.alias("mid"), same(acc["lo"], mid).alias("same")), lambda x: F.struct(F.when(x["same"], x["mid"]).otherwise(acc["lo"]).alias("lo"), F.when(x["same"], acc["hi"]).otherwise(x["mid"] - 1).alias("hi")))

    # As many steps as size has bits: each leaves half.
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int") + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve)["lo"].cast("bigint")


def _prefix(a: Column, b: Column) -> Column:
    return _most(F.least(F.octet_length(a), F.octet_length(b)), lambda m, n: F.substring(a, m + 1, n - m) == F.substring(b, m + 1, n - m))


def _bytes(left: Column, right: Column) -> Column:
    return F.struct(F.encode(left, "UTF-8").alias("a"), F.encode(right, "UTF-8").alias("b"))


def common_prefix_bytes(left: Column, right: Column) -> Column:
    """Bytes in which two texts agree from the start, each compared at most twice."""
    return bound(_bytes(left, right), lambda x: _prefix(x["a"], x["b"]))


def changed_bytes(left: Column, right: Column) -> Column:
    """Bytes between the common start and the common end of two texts, the larger side. What the common start takes can't be part of the common end."""

    def tail(x: Column) -> Column:
        a, b = x["a"], x["b"]
        i, j = F.octet_length(a), F.octet_length(b)
        end = _most(F.least(i, j) - x["start"].cast("int"), lambda m, n: F.substring(a, i - n + 1, n - m) == F.substring(b, j - n + 1, n - m))
        return F.greatest(i, j) - x["start"] - end

    return bound(_bytes(left, right), lambda x: bound(F.struct(x["a"].alias("a"), x["b"].alias("b"), _prefix(x["a"], x["b"]).alias("start")), tail))


def escape_attribute(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def json_escaped(text: Column) -> Column:
    """The text as the inside of a JSON string."""
    quoted = F.to_json(F.struct(text.alias("t")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)
