"""License scans with a positional index of rare words; DataFrame functions only.

Templates are licence wordings with a label and mandatory key phrases. The index holds, for
each template, its words by their document frequency in the scanned texts. The rarest word of
the first key phrase is the entry: of all licence words that a file must hold to match, that
is the one of highest IDF. Each place of it in a file gives the template a start. Around a
start the template's rarest words are intersected by their relative positions: so many are
looked at that at least INTERSECT of them stand in any place that can match. A start that is
left stands if all key phrases are there word for word and SHARE or more of the template's
words are at their relative positions. Base templates are their own key phrases, and all
their places are found.

Scale: one pass over the texts and no shuffle of them. It leaves the template words in each
text, and the words of those texts that hold all words of some key phrase; document
frequencies are counts over the former with at most one row a word and partition. The index is
one constant of the plan, an array of templates, whatever their number: INDEX_WORDS bounds it,
and what is beyond is refused.

Cases: null, empty and wordless texts have no words and no labels, score 0. Texts are
scanned whole. A template's places may overlap those of others and all count. Equally
frequent words tie by code point. Rows without doc_id and repeated rows are scanned like
others. Empty tables give empty results. Other columns pass through, whatever their names;
n_words and places are replaced, text is left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, written
from .license_texts import BASE, TEMPLATES

#: What lies between words; those are runs of a-z, 0-9 and all beyond ASCII, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE, INTERSECT, INDEX_WORDS = 0.8, 2, 1_000_000


_INDEX = (
    "array<struct<entry: struct<at: int, w: string>, rare: array<struct<at: int, w: string>>, needed: int,"
    " keys: array<struct<at: int, words: array<string>>>, words: array<string>>>"
)


class Template:
    """Words of a wording, and where its key phrases stand in it."""

    def __init__(self, label: str, phrases: list[str], wording: str, base: bool = False):
        self.label, self.base = label, base
        self.words = re.findall("[0-9a-z]+", wording.lower())
        self.keys = [(self._place(p.split()), p.split()) for p in phrases]

    def _place(self, key: list[str]) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)

    def lacking(self) -> int:
        """Words that a place may lack."""
        return next(n for n in range(len(self.words), -1, -1) if (len(self.words) - n) / len(self.words) >= SHARE)


def templates() -> list[Template]:
    """All templates, base ones first."""
    return [*(Template(label, [words], words, True) for words, label in BASE), *(Template(label, keys, wording) for label, keys, wording in TEMPLATES)]


def words_of(text: Column) -> Column:
    """Words of the whole text in lower case.

    Which characters belong to words doesn't depend on case. A sign beyond ASCII whose lower
    case is an ASCII letter (the kelvin sign) is set aside, as only A-Z may become a-z.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))
    return F.array_remove(F.split(F.lower(plain), BETWEEN, -1), "")


def _literals(words: list[str]) -> Column:
    """An array of words; as one literal, which Spark plans faster than one of each."""
    return F.split(F.lit(" ".join(words)), " ")


def looked_up(docs: DataFrame, known: list[Template]) -> tuple[DataFrame, list[Column]]:
    """docs with n_words, present (the template words in the text) and, where all words of some first key phrase are there, words; and the columns of docs.

    The only pass over the texts; written, as document frequencies and places both come from it.
    """
    rows, back = numbered(docs, ("text", "n_words", "places"), words=words_of(F.col("text")))
    keys = sorted({tuple(sorted(set(t.keys[0][1]))) for t in known})
    rows = rows.withColumn("present", F.array_intersect(_literals(sorted({w for t in known for w in t.words})), F.col("words")))
    rows = rows.withColumn("_keys", F.array_intersect(_literals(sorted({w for key in keys for w in key})), F.col("present")))
    some = reduce(lambda a, b: a | b, (F.size(F.array_except(_literals(list(key)), F.col("_keys"))) == 0 for key in keys))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint")).withColumn("words", F.when(some, F.col("words")))
    return written(rows.drop("_keys"), "licence-words"), back


def frequencies(rows: DataFrame) -> dict[str, int]:
    """Texts with each template word; one number a template word reaches the driver."""
    seen = rows.select(F.explode("present").alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in seen.collect()}


def index_of(known: list[Template], frequency: dict[str, int]) -> Column:
    """The positional index: each template's entry, rarest words, key phrases and words with their places, as one array."""
    if sum(len(t.words) for t in known) > INDEX_WORDS:
        raise ValueError(f"templates have over {INDEX_WORDS} words")

    def words(places: Iterable[int], t: Template) -> list[dict]:
        return [{"at": i, "w": t.words[i]} for i in places]

    rows = []
    for t in known:
        rarest = sorted(range(len(t.words)), key=lambda i: (frequency.get(t.words[i], 0), t.words[i], i))
        first, key = t.keys[0]
        looked = rarest[: t.lacking() + INTERSECT]
        rows.append({
            "entry": words([min(range(first, first + len(key)), key=rarest.index)], t)[0], "rare": words(looked, t), "needed": len(looked) - t.lacking(),
            "keys": [{"at": i, "words": k} for i, k in t.keys], "words": t.words,
        })
    return F.from_json(F.lit(json.dumps(rows)), _INDEX)


def _same(at: Column, word: Column) -> Column:
    """Whether the text's word at a place is word; false outside the text."""
    return (at >= 0) & F.coalesce(F.get("words", at) == word, F.lit(False))


def scanned(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words and places: array<struct<template, start, share>>; template counts from 0, base ones first."""
    known = templates()
    rows, back = looked_up(docs, known)
    index = index_of(known, frequencies(rows))
    numbers = F.array(*(F.lit(i) for i in range(len(known))))
    entries = F.array_distinct(F.transform(index, lambda t: t["entry"]["w"]))

    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(entries, x["w"]))
    rows = rows.withColumn("_hits", F.when(F.arrays_overlap("words", entries), at))

    def starts(hit: Column) -> Column:
        of_word = F.filter(numbers, lambda n: F.get(index, n)["entry"]["w"] == hit["w"])
        return F.transform(of_word, lambda n: F.struct(n.alias("template"), (hit["i"] - F.get(index, n)["entry"]["at"]).alias("start")))

    def intersects(c: Column) -> Column:
        t = F.get(index, c["template"])
        return F.size(F.filter(t["rare"], lambda r: _same(c["start"] + r["at"], r["w"]))) >= t["needed"]

    def has_keys(c: Column) -> Column:
        def there(key: Column) -> Column:
            first = c["start"] + key["at"]
            return (first >= 0) & (F.slice("words", F.greatest(first, F.lit(0)) + 1, F.size(key["words"])) == key["words"])

        return F.forall(F.get(index, c["template"])["keys"], there)

    def place(c: Column) -> Column:
        words = F.get(index, c["template"])["words"]
        found = F.size(F.filter(F.transform(words, lambda w, i: _same(c["start"] + i, w)), lambda same: same))
        return F.struct(c["template"].alias("template"), c["start"].cast("bigint").alias("start"), (found / F.size(words).cast("double")).alias("share"))

    rows = rows.withColumn("_starts", F.filter(F.flatten(F.transform("_hits", starts)), intersects))
    rows = rows.withColumn("_places", F.filter(F.transform(F.filter("_starts", has_keys), place), lambda p: p["share"] >= SHARE))
    return rows.select(*back, "n_words", F.col("_places").alias("places"))


_PLACES = "array<struct<template:int,start:bigint,share:double>>"


def _labels(places: Column) -> Column:
    names = _literals([t.label for t in templates()])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(names, p["template"])))), ",")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.coalesce(F.filter("places", lambda p: p["template"] < len(BASE)), F.array().cast(_PLACES))
    out = out.select("doc_id", "n_words", "places", base.alias("base"))
    starts = F.transform("base", lambda p: p["start"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"), F.coalesce(_labels(F.col("places")), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def license_sql() -> str:
    """The same in DuckDB SQL, by comparing the words at every place with every template."""
    parts = []
    for n, t in enumerate(templates()):
        (k, key), share = t.keys[0], " + ".join(f"CASE WHEN s.i + {i} > 0 AND w[s.i + {i}] = '{word}' THEN 1 ELSE 0 END" for i, word in enumerate(t.words))
        phrases = " AND ".join(f"s.i + {i} > 0 AND list_slice(w, s.i + {i}, s.i + {i + len(words) - 1}) = {words!r}" for i, words in t.keys)
        parts.append(
            f"SELECT doc_id, {n} AS t, '{t.label}' AS label, {t.base} AS base, s.i - 1 AS start, ({share}) / {float(len(t.words))} AS share"
            f" FROM d, (SELECT unnest(range(1 - {k}, n + 1 - {k})) AS i, doc_id AS j, n FROM d WHERE list_has_all(w, {key!r})) s WHERE d.doc_id = s.j AND {phrases}"
        )
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, len(regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS n FROM documents),
p AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (base) AS nb, min(start) FILTER (base) AS f, max(start) FILTER (base) AS l, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS bl,
      array_to_string(list_sort(list_distinct(list(label))), ',') AS al, max(share) AS sc FROM p WHERE share >= {SHARE} GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_words, coalesce(nb, 0) AS n_base, f AS first_word, l AS last_word, coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, CAST(coalesce(sc, 0.0) AS DOUBLE) AS score FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
