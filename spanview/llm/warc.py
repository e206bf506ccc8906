"""WARC archives without repeated payloads, and their reader, which resolves revisits.

Headers (page, URL, digest, length) are dealt out by payload digest, and the capture with the
smallest page_id of each digest is the original. Every other capture of it becomes a
revisit record, which has fresh headers, names the original and repeats no payload. The
archives are WARC/1.1 files of one gzip member a record, so that a reader can start at any
record. They are written and read by Spark's own text source, to any file system that it
reaches: an empty gzip member stands between two records and is where Spark splits a file.
The reader parses records by their lengths, computes each response's digest anew, and joins
revisits with the responses that they refer to.

Scale: payloads stay where they are read. Only digests with more than one capture go on, and
mark FILTER_BITS bits of a filter; a page whose digest passes none is written at once. Revisits are
made of headers alone, and of a repeated payload only the original's is shuffled, to be
written. Where the filter fills up, more payloads are shuffled, with the same result. A task
holds a batch of records when reading, however large its file.

Cases: a null page is an empty payload, an empty payload is a payload like others. Payloads
shorter than the bound in bytes are all responses. Null URLs are written as an empty target
and read back as null. Captures equal in page_id and payload tie: all are responses. Null
page_ids come after all others. White space in URLs is percent-encoded. Payloads may hold
line ends, record heads or any characters. Empty tables give an archive without records.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import new_path, spread, table, written

LEAST_BYTES = 0
#: Bits of the filter of repeated digests: 2^17 words of 64, the bound of what is broadcast (2 MB).
FILTER_BITS = 1 << 23
#: Stands between records: a whole gzip member of no bytes.
BETWEEN = gzip.compress(b"", mtime=0)
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are four digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _headed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, bytes) of each page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("bigint")})


def _bit(*key: Column) -> dict[str, Column]:
    """Word and bit of a key in a filter."""
    place = F.xxhash64(*key).bitwiseAND(F.lit(FILTER_BITS - 1))
    return {"_word": F.shiftright(place, 6), "_bit": place.bitwiseAND(F.lit(63)).cast("int")}


def _filter(keys: DataFrame, *key: str) -> DataFrame:
    """(word, bits) of the filter that holds all keys; at most FILTER_BITS / 64 rows."""
    places = keys.select(*(c.alias(n) for n, c in _bit(*(F.col(k) for k in key)).items()))
    bits = F.bit_or(F.expr("shiftleft(1L, _bit)"))
    return places.groupBy(F.col("_word").alias("word")).agg(bits.alias("bits"))


def _passing(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """rows with _in: whether the key may be among those of the filter."""
    placed = rows.withColumns(_bit(*(F.col(k) for k in key)))
    joined = placed.join(F.broadcast(bits), F.col("_word") == F.col("word"), "left")
    is_set = F.expr("shiftright(bits, _bit) & 1") == 1
    return joined.withColumn("_in", F.coalesce(is_set, F.lit(False))).drop("_word", "_bit", "word", "bits")


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, bytes, record_type, original, original_url) for each page; revisits have no html."""
    rows = _headed(pages)
    heads = written(rows.select("page_id", "url", "digest", "bytes"), "warc-heads")
    repeated = heads.groupBy("digest", "bytes").agg(F.min("page_id").alias("original"), F.min_by("url", "page_id").alias("original_url"), F.count("*").alias("captures"))
    repeated = written(repeated.filter((F.col("captures") > 1) & (F.col("bytes") >= least_bytes) & F.col("original").isNotNull()).drop("captures"), "warc-repeated")
    digests = written(_filter(repeated, "digest"), "warc-filter")

    names = ("page_id", "url", "html", "digest", "bytes")
    looked = _passing(rows, digests, "digest")
    at_once = looked.filter(~F.col("_in")).select(*names)
    # Of the headers that pass, those with a repeated digest are revisits but for the original, and the others have none after all.
    found = _passing(heads, digests, "digest").filter("_in").select("page_id", "url", "digest", "bytes").join(repeated, ["digest", "bytes"], "left")
    is_revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    revisits = found.filter(is_revisit)
    # The payloads of the rest: a second filter, by page and digest, keeps those of the revisits out of the shuffle.
    rest = written(found.filter(~is_revisit).select("page_id", "digest", "bytes").distinct(), "warc-originals")
    pages_of = written(_filter(rest, "page_id", "digest"), "warc-filter")
    may_be = _passing(looked.filter("_in").select(*names), pages_of, "page_id", "digest").filter("_in").select(*names)
    wanted = rest.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("bytes").alias("b"))
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b"))
    originals = may_be.join(wanted, same, "left_semi")

    whole = at_once.unionByName(originals).withColumns({"record_type": F.lit("response"), "original": F.lit(None).cast("bigint"), "original_url": F.lit(None).cast("string")})
    return whole.unionByName(revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "bytes", F.lit("revisit").alias("record_type"), "original", "original_url"))


def records(plan: DataFrame) -> DataFrame:
    """(value): one record a row, whole."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def address(url: Column) -> Column:
        out = F.coalesce(url, F.lit(""))
        for char in ("\r", "\n", "\t", " "):
            out = F.replace(out, F.lit(char), F.lit(f"%{ord(char):02X}"))
        return out

    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    length = F.when(revisit, F.lit(len(_HTTP))).otherwise(F.col("bytes") + len(_HTTP))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uuid(page, F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", address(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _uuid(F.col("original").cast("string"), F.col("digest"))), line("WARC-Refers-To-Target-URI", address(F.col("original_url"))), line("WARC-Refers-To-Date", F.lit(DATE)),
        )).otherwise(F.lit("")),
        line("X-Page-Id", page),
        line("X-Url-Null", F.col("url").isNull().cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n" + _HTTP),
    )
    return plan.select(F.concat(head, F.coalesce(F.col("html"), F.lit("")), F.lit(_END)).alias("value"))


@F.pandas_udf(BinaryType())
def member(record: pd.Series) -> pd.Series:
    """A gzip member of each record."""
    return record.map(lambda x: gzip.compress(bytes(x), 6, mtime=0))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives of all pages under path, a gzip member a record."""
    out = records(planned(pages, least_bytes)).select(member(F.col("value").cast("binary")).cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    while True:
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        headers = {}
        while (text := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = text.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("archive ends within a record")
        yield headers, block


_READ = "page_id bigint, url string, record_id string, record_type string, digest string, stated string, bytes bigint, refers_to_record string"


def _read(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _READ.split(", ")] + (["payload"] if payloads else [])
    for pdf in batches:
        rows = []
        for content in pdf["content"]:
            for headers, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                payload = block.partition(b"\r\n\r\n")[2]
                response = headers["warc-type"] == "response"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else None
                page, url = headers.get("x-page-id"), headers.get("warc-target-uri", "")
                rows.append((int(page) if page else None, None if headers.get("x-url-null") == "true" else url, headers.get("warc-record-id"), headers["warc-type"], digest,
                             headers.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload) if response else None, headers.get("warc-refers-to"), *([payload if response else None] if payloads else [])))
        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "bytes": "Int64"})


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records under path; revisits have no digest, bytes or payload of their own."""
    members = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(path)
    return members.select(F.col("value").cast("binary").alias("content")).mapInPandas(lambda it: _read(it, payloads), _READ + (", payload binary" if payloads else ""))


def resolved(read: DataFrame) -> DataFrame:
    """Records with the digest, length and page of the response that each revisit refers to."""
    names = ["digest", "bytes"] + (["payload"] if "payload" in read.columns else [])
    responses = read.filter("record_type = 'response'")
    kept = [c for c in read.columns if c != "refers_to_record"]
    whole = responses.select(*kept, F.lit(None).cast("bigint").alias("refers_to"))
    # Captures that tie share a record id; a revisit resolves to one of them.
    targets = responses.filter("page_id is not null").groupBy("record_id").agg(F.max("page_id").alias("_page"), *(F.first(c).alias(f"_{c}") for c in names))
    # Both sides are dealt out for themselves, so that the revisits of one record can be split.
    targets = targets.select(spread(F.xxhash64("record_id")).alias("_key"), F.col("record_id").alias("_id"), "_page", *(f"_{c}" for c in names))
    revisits = read.filter("record_type != 'response'").withColumn("_key_of", spread(F.xxhash64("refers_to_record")))
    revisits = revisits.join(targets, (F.col("_key_of") == F.col("_key")) & (F.col("refers_to_record") == F.col("_id")), "left")
    found = revisits.select(*(F.col(f"_{c}").alias(c) if c in names else F.col(c) for c in kept), F.col("_page").alias("refers_to"))
    return whole.unionByName(found)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # Written, as responses and revisits are looked at apart; the archives are parsed once.
    out = resolved(written(read_archives(spark, path), "warc-read"))
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
