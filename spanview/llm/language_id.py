"""Language identification by compression against per-language dictionaries.

Each language has a raw-content zstandard dictionary made of its own training text. A text
is encoded with each dictionary, whole and once more as the list of its distinct words, so
that repetition does not hide the language; it goes to the language whose dictionary gives
the fewest bytes in all. All texts are scored so, whatever their size. A text is rejected
where the two best sizes are within MARGIN of each other, relative to the best, and where the
best dictionary makes it larger than no dictionary does.

The sample that the dictionaries are made of holds the distinct texts of the smallest hashes
of every language: at most SAMPLE_ROWS texts and DICT_BYTES a language, and ALL_ROWS and
ALL_BYTES of all languages together, which they share evenly, so that none goes without.

Cases: null, empty or letterless text (none of Unicode's letters) is `und` with score 0 and
rejected. Very long texts are encoded whole, in chunks of CHUNK bytes. A tie goes to the
language with more training rows and is rejected. Of one language alone, only the gain over
no dictionary decides. Null or empty language labels teach nothing. Repeated rows are
predicted alike. An empty table, or one without labels, gives `und` throughout. Other
columns pass through; columns named lang_pred, score, margin or rejected are replaced.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, numbered, table, written

#: Bounds of the training sample: texts and bytes of each language's dictionary, and of all languages together.
SAMPLE_ROWS, DICT_BYTES = 600, 262_144
ALL_ROWS, ALL_BYTES = 128 * SAMPLE_ROWS, 128 * DICT_BYTES
#: Bytes of one frame, the levels for a text and for its distinct words, and the dictionary's end that each frame starts with.
CHUNK, LEVEL, DISTINCT_LEVEL, CARRIER = 16_384, 3, 7, 256
#: Relative margin under which a text is rejected.
MARGIN = 0.01
#: Odds of the best language fall by this power of e with each byte of lead.
BYTE_WEIGHT = 0.35

_LETTER, _BETWEEN = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def normalised(text: str) -> str:
    """Lower-case words of letters and their marks, one space around each."""
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} "


def _languages(labelled: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The usable rows with the hash of their text, and (lang, n, texts, langs): rows and distinct texts of each language, and how many languages there are."""
    usable = labelled.select("lang", "text").filter("lang IS NOT NULL AND lang != '' AND text IS NOT NULL AND text rlike '\\\\p{L}'").withColumn("key", F.xxhash64("text", F.lit(seed)))
    # Copies are put together before the shuffle, so that no more than hashes of distinct texts move.
    counts = usable.groupBy("lang", "key").count().groupBy("lang").agg(F.sum("count").alias("n"), F.count("*").alias("texts"))
    # Written, so that Spark knows the size of this table of one row a language when it joins it.
    counts = written(counts, "languages")
    return usable, counts.withColumn("langs", F.lit(max(1, counts.count())))


def _shared(bound: int, of_all: int) -> Column:
    """What each of `langs` languages may have where each has a bound and all have one together."""
    return F.greatest(F.lit(1), F.least(F.lit(bound), F.floor(F.lit(of_all) / F.col("langs")))).cast("int")


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """At most `rows` distinct texts (lang, text) of each language, chosen by a hash of the text."""
    usable, counts = _languages(labelled, seed)
    counts = counts.withColumn("rows", _shared(rows, ALL_ROWS))
    # A hash threshold first leaves about twice the bound, so that the ranking below is small for any language.
    near = usable.join(counts, "lang").filter(F.shiftrightunsigned("key", 33) < (F.lit(2.0) * F.col("rows") + 40) / F.col("texts") * F.lit(2.0**31))
    # Copies of one text are one row, put together before the shuffle.
    near = near.select("lang", "text", "key", "n", "texts", "rows", "langs").distinct()
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text")))
    return ranked.filter(F.col("r") <= F.col("rows")).select("lang", "text", "n", F.least("texts", "rows").alias("used"), "langs", "r")


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """[(lang, dictionary)], languages with more training rows first. Bounded by rows and dict_bytes a language."""
    # Of a longer text, a slice that a hash of the text places; a language's slices fill its dictionary about twice.
    size = F.greatest(F.lit(CARRIER), _shared(dict_bytes, ALL_BYTES))
    share = F.greatest(F.least(F.lit(2000), size), F.lit(2) * size / F.col("used")).cast("int")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - share, F.lit(0)) + 1).cast("int") + 1
    got = sample(labelled, rows).select("lang", "n", "r", size.alias("size"), F.substring("text", start, share).alias("text"))
    texts: dict[tuple[int, str], list[str]] = {}
    for lang, n, _, most, text in sorted(got.collect(), key=lambda x: x[:3]):
        texts.setdefault((-n, lang, most), []).append(normalised(text))
    model = []
    for (_, lang, most), own in sorted(texts.items()):
        parts, size = [], 0
        for text in own:
            parts.append(text.encode())
            size += len(parts[-1])
            if size >= most:
                break
        model.append((lang, b"".join(parts)[:most]))
    return model


class _Encoders:
    """One encoder a dictionary, or one without, at one level."""

    def __init__(self, dictionaries: list[bytes | None], level: int):
        self.each = []
        for data in dictionaries:
            if data:
                known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=level)
                encoder = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            else:
                # The tables are made for frames of this size; those for unknown sizes are slow to clear.
                asked = zstandard.ZstdCompressionParameters.from_level(level, source_size=CHUNK, write_content_size=0, write_checksum=0, write_dict_id=0)
                encoder = zstandard.ZstdCompressor(compression_params=asked)
            # A frame of a few bytes is stored as it is; after the dictionary's end, which costs one match, it is encoded.
            carrier = data[-CARRIER:] if data else b""
            self.each.append((encoder, carrier, len(encoder.compress(carrier))))

    def sizes(self, data: bytes) -> list[int]:
        """Bytes that data takes with each dictionary, in frames."""
        frames = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(max(1, len(encoder.compress(carrier + x)) - alone) for x in frames) for encoder, carrier, alone in self.each]


class Classifier:
    """Encoders of one model; made once in each Python worker."""

    def __init__(self, model: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in model]
        # The last one has no dictionary.
        dictionaries = [*(data for _, data in model), None]
        self.whole, self.distinct = _Encoders(dictionaries, LEVEL), _Encoders(dictionaries, DISTINCT_LEVEL)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(lang_pred, score, margin in bytes, rejected)."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0, True
        words = normalised(text)
        whole = self.whole.sizes(words.encode("utf-8", "replace"))
        distinct = self.distinct.sizes(f" {' '.join(dict.fromkeys(words.split()))} ".encode("utf-8", "replace"))
        *sizes, plain = (a + b for a, b in zip(whole, distinct))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        margin = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + 1) - sizes[best]
        score = 1 / sum(math.exp(-BYTE_WEIGHT * (s - sizes[best])) for s in sizes)
        narrow = len(sizes) > 1 and margin < MARGIN * sizes[best]
        return self.langs[best], score, float(margin), narrow or sizes[best] > plain


_ready: dict[str, Classifier] = {}


def predictor(spark: SparkSession, model: list[tuple[str, bytes]]):
    """Column function: text -> struct(lang_pred, score, margin, rejected)."""
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        if key not in _ready:
            _ready.clear()
            _ready[key] = Classifier(shared.value)
        known = _ready[key]
        return pd.DataFrame([known.predict(x) for x in text], columns=["lang_pred", "score", "margin", "rejected"])

    return predict


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """docs with lang_pred, score, margin (bytes) and rejected."""
    found = predictor(docs.sparkSession, model)(F.col("text"))
    rows, back = numbered(docs, ("lang_pred", "score", "margin", "rejected"), found=found)
    return rows.select(*back, "found.*")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang is left as it was."""
    return identify(docs, fit(training_rows(docs))).filter(~F.col("rejected")).select(*columns(docs))
