"""Secret scans that link the parts of credentials; DataFrame functions only.

Three base patterns find assigned secrets, access identifiers and long hexadecimal runs.
Weaker patterns find what may be an identifier, a secret or an endpoint. Such a candidate is
reported only with its complement in the same scope, SCOPE characters to either side: an
identifier with a secret, a secret with an identifier, an endpoint with both. The join of
the parts' intervals is by order: for each part, the latest end of the complements that start
before it, and the earliest start of those that follow.

A pattern's places come from the lengths of its matches and of what lies between them,
summed up in order. Offsets are code points.

Scale: texts are read once, and what goes on is lengths. Only matches are dealt out, by
document; a document's matches are ordered in one task and may spill.

Cases: null and empty texts have no spans; the digest is that of the empty string. Texts
are scanned whole. Spans of different kinds may overlap or be equal, all count, and tie in
the order of KINDS. Rows without doc_id and repeated rows are scanned like others. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

SCOPE = 300
#: Kind, pattern, group whose length counts and the least length. The hexadecimal and access patterns ask for their
#: length at once: their runs are maximal, so the runs that are long enough are the same.
KINDS = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("id", r"(?i:client|account|access|key|user|tenant|app)[_-]?(?i:key[_-]?)?(?i:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9][A-Za-z0-9._@-]{3,}", 0, 0),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])", 0, 0),
    ("endpoint", r"(?i:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftps?|ssh)://[A-Za-z0-9][A-Za-z0-9._~:@/?#%&=+-]*", 0, 0),
)
BASE = 3
#: Kinds that count as identifiers and as secrets when parts are linked.
IDENTIFIERS, SECRETS = (1, 3), (0, 4)

_PARTS = "array<struct<kind:int,k:int,gap:int,len:int,ok:boolean>>"


def _lengths(text: Column, kind: int) -> Column:
    """Each match of a kind: its number, the characters since the match before, its own, and whether it is long enough."""
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    between = F.transform(F.split(text, pattern, -1), F.length)
    own = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length) if group else own
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(own)).alias("a"), own.alias("b"), counted.alias("c"))
    each = F.transform(zipped, lambda z, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), z["a"].alias("gap"), z["b"].alias("len"), (z["c"] >= least).alias("ok")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast(_PARTS))


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id) of all rows, and (uid, kind, start, end) of the spans long enough, weak ones included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(*(_lengths(text, i) for i in range(len(KINDS))))
    rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), parts.alias("parts")), "secret-parts")
    each = rows.select("uid", F.inline("parts"))
    run = Window.partitionBy("uid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).filter("ok")
    return rows.select("uid", "doc_id"), placed.select("uid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """spans without the weak ones whose complements are not in scope."""
    # Both frames grow from the first row, so that a row costs one step; what follows is seen in the reversed order.
    grows = (Window.unboundedPreceding, -1)
    before = Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(*grows)
    after = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(*grows)

    def near(kinds: tuple[int, ...]) -> Column:
        mine = F.col("kind").isin(*kinds)
        back = F.max(F.when(mine, F.col("end"))).over(before) >= F.col("start") - scope
        ahead = F.min(F.when(mine, F.col("start"))).over(after) <= F.col("end") + scope
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    seen = spans.withColumns({"_id": near(IDENTIFIERS), "_secret": near(SECRETS)})
    kind = F.col("kind")
    keep = (kind < BASE) | (kind == 3) & F.col("_secret") | (kind == 4) & F.col("_id") | (kind == 5) & F.col("_id") & F.col("_secret")
    return seen.filter(keep).select("uid", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(name) for name, *_ in KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def scanned(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans (array<struct<start, kind, end>> in order) of each row of docs."""
    rows, spans = matches(docs)
    found = linked(spans, scope).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return rows.join(found, "uid", "left").select("doc_id", "spans")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint"), F.lit(0).cast("bigint"))

    n = [F.when(F.col("spans").isNull(), F.lit(0).cast("bigint")).otherwise(count(i)).alias(f"n_{KINDS[i][0]}") for i in range(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return out.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def secret_sql() -> str:
    """The same in DuckDB SQL: spans of each kind from what lies between matches; opaque ones as whole runs with their padding, for want of lookaround."""
    simple = {
        0: ("(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 12), 1: ("AKIA[A-Z0-9]+", 0, 18), 2: ("[0-9a-f]+", 0, 16),
        3: ("(?i:client|account|access|key|user|tenant|app)[_-]?(?i:key[_-]?)?(?i:id|name)[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9][A-Za-z0-9._@-]{3,}", 0, 0), 4: ("[A-Za-z0-9+/_-]+=*", 0, 32),
        5: ("(?i:https?|postgres(?:ql)?|mysql|mongodb(?:\\+srv)?|redis|amqps?|s3|ftps?|ssh)://[A-Za-z0-9][A-Za-z0-9._~:@/?#%&=+-]*", 0, 0),
    }
    parts = []
    for kind, (p, g, least) in simple.items():
        # Padding of which another run follows at once is an equals sign before a value.
        extra = " AND NOT (i < len(m) AND s[i + 1] = '') AND regexp_matches(m[i], '^[A-Za-z0-9+/_-]{32,}={0,2}$') AND regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')" if kind == 4 else ""
        only = {2: " AND regexp_matches(t, '[0-9a-f]{16}')", 4: " AND regexp_matches(t, '[A-Za-z0-9+/_-]{32}')"}.get(kind, "")
        parts.append(
            f"SELECT doc_id, {kind} AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'e': CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT),"
            f" 'n': length(m[i]), 'ok': length(c[i]) >= {least}{extra}}}), lambda z: z.ok)) AS z FROM (SELECT doc_id, string_split_regex(t, '{p}') AS s, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS c FROM d WHERE regexp_matches(t, '{p}'){only})"
        )
    near = "EXISTS (SELECT 1 FROM sp b WHERE b.doc_id = a.doc_id AND b.kind IN ({}) AND (b.s, b.e, b.kind) <> (a.s, a.e, a.kind) AND CASE WHEN (b.s, b.e, b.kind) < (a.s, a.e, a.kind) THEN b.e >= a.s - 300 ELSE b.s <= a.e + 300 END)"
    ident, secret = near.format("1, 3"), near.format("0, 4")
    name = "['assign', 'access', 'hex', 'id', 'opaque', 'endpoint'][kind + 1] || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), sp AS (SELECT doc_id, kind, z.e - z.n AS s, z.e AS e FROM ({" UNION ALL ".join(parts)})),
k AS (SELECT * FROM sp a WHERE kind < 3 OR (kind = 3 AND {secret}) OR (kind = 4 AND {ident}) OR (kind = 5 AND {ident} AND {secret})),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, coalesce(string_agg({name}, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS bs, string_agg({name}, ',' ORDER BY s, kind, e) AS al FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(al, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
