"""Relocation, symbols, replay, generated traces and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics, provenance, relocate, replay, symbols
from ..sources import readers, writers
from ..streaming import sessions
from .tables import TASK, scratch, table

FIRST, LAST = 2, 4


def _regions(spark, sf_dir):
    """Lines 2 to 4 of each document, and its text after an edit that doc_id chooses; a document of fewer lines gets some around it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    around = F.concat(F.lit("begin\n"), "t", F.lit("\nend a\nend b"))
    d = d.withColumn("t", F.when(F.size(F.split("t", "\n", -1)) < LAST, around).otherwise(F.col("t"))).withColumn("lines", F.split("t", "\n", -1))
    content = F.array_join(F.slice("lines", FIRST, LAST - FIRST + 1), "\n")
    k = F.col("doc_id") % 7
    inside = F.transform("lines", lambda x, i: F.when(i == FIRST, F.concat(x, F.lit(" changed"))).otherwise(x))
    renamed = F.transform("lines", lambda x, i: F.when(i == FIRST - 1, F.concat(x, F.lit(" renamed"))).otherwise(x))
    grown = F.concat(F.slice("lines", 1, LAST - 1), F.array(F.lit("grown")), F.slice("lines", F.lit(LAST), F.size("lines")))
    current = (
        F.when(k == 0, F.col("t")).when(k == 1, F.concat(F.lit("above\n"), "t")).when(k == 2, F.array_join(inside, "\n")).when(k == 3, F.concat("t", F.lit("\n"), content))
        .when(k == 4, F.concat(F.lit("above\n"), F.array_join(inside, "\n"))).when(k == 5, F.array_join(renamed, "\n")).otherwise(F.array_join(grown, "\n"))
    )
    out = d.select("doc_id", "t", content.alias("content"), current.alias("current"), F.lit(FIRST).alias("start_line"))
    return out.withColumn("anchors", relocate.anchors(F.col("content"), F.col("start_line")))


_REGIONS_SQL = r"""
o0 AS (SELECT doc_id, CASE WHEN len(string_split(coalesce(text, ''), chr(10))) < 4 THEN 'begin' || chr(10) || coalesce(text, '') || chr(10) || 'end a' || chr(10) || 'end b' ELSE text END AS t FROM documents),
d AS (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM o0),
e AS (SELECT *, array_to_string(l[2:4], chr(10)) AS content,
  CASE doc_id % 7 WHEN 0 THEN t WHEN 1 THEN 'above' || chr(10) || t WHEN 2 THEN array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 3 THEN x || ' changed' ELSE x END), chr(10)) WHEN 3 THEN t || chr(10) || array_to_string(l[2:4], chr(10))
  WHEN 4 THEN 'above' || chr(10) || array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 3 THEN x || ' changed' ELSE x END), chr(10)) WHEN 5 THEN array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 2 THEN x || ' renamed' ELSE x END), chr(10))
  ELSE array_to_string(list_concat(l[1:3], ['grown'], l[4:]), chr(10)) END AS cur FROM d),
r AS (SELECT doc_id, content, cur, list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS own, list_transform(string_split(cur, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS now FROM e),
a AS (SELECT *, list_filter(own, lambda x: x <> '') AS f, len(own) AS n FROM r),
p AS (SELECT doc_id, unnest(range(len(now))) AS pos, unnest(now) AS line, f[1] AS first, f[-1] AS last, n FROM a)"""


def exact_relocate(spark, sf_dir):
    return relocate.exact(_regions(spark, sf_dir)).select("doc_id", "places", F.col("exact_start").cast("bigint").alias("exact_start"))


def anchor_best_unique(spark, sf_dir):
    return relocate.boundary_pairs(_regions(spark, sf_dir), ["doc_id"]).filter("rank = 1").select("doc_id", "start_at", "end_at", "span_delta", "distance", "tied")


def consensus_votes(spark, sf_dir):
    return relocate.consensus_votes(_regions(spark, sf_dir), ["doc_id"]).select("doc_id", "start_at", "support", "interior", "rank")


def consensus_start(spark, sf_dir):
    return relocate.consensus(relocate.consensus_votes(_regions(spark, sf_dir), ["doc_id"]), ["doc_id"])


def _relocated(spark, sf_dir):
    r = _regions(spark, sf_dir)
    u = r.select(F.lit(1).alias("session"), F.col("doc_id").cast("string").alias("unit_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.lit("region").alias("scope"), F.lit(None).cast("string").alias("selector"), "content", "start_line", F.lit(LAST).alias("end_line"), F.lit(None).cast("int").alias("file_lines"))
    files = r.select(F.lit(1).alias("session"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("current").alias("content")).filter("path not like '%9'")
    return relocate.relocated(u, files)


def relocate_regions(spark, sf_dir):
    """The whole decision; its steps are checked by SQL, the whole by recorded traces and brute force in the tests."""
    return _relocated(spark, sf_dir).select("unit_id", "state", "method", "new_start", "new_end", F.sha2("new_content", 256).alias("content_sha256"))


def relocation_failures(spark, sf_dir):
    return relocate.failures(_relocated(spark, sf_dir))


def _sources(spark, sf_dir, kind=None):
    """Documents as source files, of the kind that their number gives or of one kind: each has the text, line by line, as comments inside a function."""
    i = F.col("doc_id").cast("string")
    own = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\x00\x0C]", " "), "\n", -1)

    def comments(sign: str):
        return F.array_join(F.transform(own, lambda x: F.concat(F.lit(f"    {sign} "), x)), "\n")

    body = F.concat(F.lit("class C"), i, F.lit(":\n    def m(self):\n        return "), i, F.lit("\n\n\ndef f"), i, F.lit("():\n"), comments("#"), F.lit("\n    pass\n"))
    script = F.concat(F.lit("export function g"), i, F.lit("(a) {\n"), comments("//"), F.lit("\n  return `}` + a;\n}\n"))
    d = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4 if kind is None else F.lit(kind)
    return d.select("doc_id", F.concat(F.lit("s"), i, F.when(kind == 0, ".py").when(kind == 1, ".js").when(kind == 2, ".txt").otherwise(".ts")).alias("path"), F.when(kind == 0, body).when(kind == 3, F.concat(script, F.lit("{"))).otherwise(script).alias("content"))


def symbol_pack(spark, sf_dir):
    """Every symbol of the documents as Python files, read by its name, moved and edited, and found again by the parser: measures of each capture."""
    files = _sources(spark, sf_dir, 0).select(F.col("doc_id").cast("string").alias("name"), "path", "content")
    return replay.replayed_files(files, replay.symbols_traces, ("unit-region",), symbols.limited(symbols.enumerate_symbols), ("trace", "capture", "method", "recall", "stale_units", "error"))


def symbol_table(spark, sf_dir):
    return symbols.symbols(_sources(spark, sf_dir)).select("path", "kind", "qualified_selector", "start_line", "end_line", "error")


def symbol_resolve(spark, sf_dir):
    s = _sources(spark, sf_dir)
    wanted = s.select(F.col("doc_id").cast("string").alias("unit_id"), "path", F.concat("path", F.lit("::f"), F.col("doc_id").cast("string")).alias("selector"))
    return symbols.resolved_symbols(wanted, symbols.symbols(s))


def _files(docs):
    return docs.select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def _traces(spark, sf_dir, docs=None):
    """Lines 2 to 4 of each document through every mutation family that they admit."""
    return replay.generated(_files(table(spark, sf_dir, "documents") if docs is None else docs), FIRST, LAST)


def trace_replay(spark, sf_dir):
    """Every mutation family of every document through every system."""
    columns = ("trace", "family", "system", "capture", "method", "recall", "exact_rate", "stale_bytes", "duplicate_units", "payload_bytes", "error")
    return replay.replayed_files(_files(table(spark, sf_dir, "documents")), replay.region_traces(FIRST, LAST), columns=columns)


def trace_events(spark, sf_dir):
    """Reads, edits and captures of the traces of all documents, by kind."""
    return replay.events_of(_traces(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


def _sampled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("repo"), F.lit("abc123").alias("commit"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("selector"), F.lit("interior-edit").alias("scenario"), F.lit(None).cast("string").alias("reason"))
    return _traces(spark, sf_dir, provenance.hash_sample(d, ["repo"], 5).filter("disposition = 'selected'"))


def sampled_traces(spark, sf_dir):
    """Traces generated from the sample of five documents a source, by family."""
    family = F.get(F.split("name", "/"), F.lit(1))
    return _sampled(spark, sf_dir).groupBy(family.alias("family")).agg(F.count("*").alias("traces"), F.min(F.size("events")).alias("least_events"))


def trace_pack(spark, sf_dir):
    """The sampled traces written as a pack, one JSON file each, and read back: events by trace, and whether the pack breaks the format."""
    path = scratch(spark, "pack")
    writers.trace_files(_sampled(spark, sf_dir), path)
    back = readers.traces(spark, path)
    errors = readers.trace_errors(back).select("name", F.array_join("errors", ",").alias("errors"))
    shots = F.size(F.filter("events", lambda e: e["type"] == "capture-request"))
    return back.select("name", F.size("events").alias("events"), shots.alias("captures"), F.size("files").alias("files")).join(errors, "name", "left")


def budget_pressure(spark, sf_dir):
    """What the last capture of each trace shows under a small budget. Traces of one name are one, as final_captures has it, which asks for all that decides a tie."""
    ties = ("method", "exact_rate", "recall", "stale_rate", "stale_units", "stale_bytes", "duplicate_units", "duplicate_bytes", "projection_bytes")
    shots = replay.replayed_files(_files(table(spark, sf_dir, "documents")), replay.pressed(replay.region_traces(FIRST, LAST)), ("unit-region", "whole-file"), columns=("trace", "system", "capture", *ties), last=True)
    out = metrics.final_captures(shots, ["trace", "system"], "capture")
    return out.groupBy("system").agg(F.count("*").alias("traces"), F.max("projection_bytes").alias("largest"), F.sum("stale_bytes").alias("stale_bytes"))


def _edited_trace(name: str, path: str, content: str) -> list[dict]:
    """The trace of one document, which name ends with the number of: a region read, the edit that the number chooses, and two captures. Region and edit are those of _regions."""
    t = content if content.count("\n") + 1 >= LAST else f"begin\n{content}\nend a\nend b"
    own, number = t.split("\n"), int(name.rsplit("/", 1)[1])

    def changed(at: int, tail: str) -> str:
        return "\n".join([*own[:at], own[at] + tail, *own[at + 1 :]])

    # The sign stays with the number, as in SQL.
    k = number % 7 if number >= 0 else -(-number % 7)
    if k == 0:
        current = t
    elif k == 1:
        current = f"above\n{t}"
    elif k == 2:
        current = changed(FIRST, " changed")
    elif k == 3:
        current = "\n".join([t, *own[FIRST - 1 : LAST]])
    elif k == 4:
        current = "above\n" + changed(FIRST, " changed")
    elif k == 5:
        current = changed(FIRST - 1, " renamed")
    else:
        current = "\n".join([*own[: LAST - 1], "grown", *own[LAST - 1 :]])
    shot = replay.event("capture-request", task=TASK, budget=12_000)
    edit = replay.event("replace-exact", path=path, expected=t, replacement=current.replace("$", "$$"))
    return [{"name": name, "repository": None, "files": {path: t}, "events": [replay.event("read", path=path, scope="region", start_line=FIRST, end_line=LAST), shot, edit, shot]}]


def document_replay(spark, sf_dir):
    """Each document as a trace: a region read, the edit that its number chooses, and two captures. The edit is made where it is replayed: the text is moved once."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("docs/edit/"), F.col("doc_id").cast("string")).alias("name"), F.lit("f").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return replay.replayed_files(files, _edited_trace, ("unit-region",), columns=("trace", "capture", "method", "stale_units", "projection_bytes", "error"))


def stream_tracked(spark, sf_dir):
    """conversations as a stream of reads: each turn with its unit's state after it."""
    source = table(spark, sf_dir, "conversations")
    stream = _stream(spark, sf_dir, "conversations", source.schema)
    reads = stream.select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.col("turn"), F.concat(F.lit("src/"), "role").alias("path"), F.lit("file").alias("scope"), F.lit(None).cast("string").alias("selector"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("text").alias("content"),
    )
    return _streamed(sessions.tracked(reads)).select("session", "seq", "unit_id", "revision", "change_count", "changed_at")


def stream_delivery(spark, sf_dir):
    source = table(spark, sf_dir, "conversations")
    stream = _stream(spark, sf_dir, "conversations", source.schema)
    events = stream.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 == 0, "pending").when(F.col("turn") % 2 == 0, "sent").otherwise("failed").alias("kind"), F.lit("u").alias("unit_id"), F.sha2("text", 256).alias("revision"))
    return _streamed(sessions.acknowledged(events))


def stream_activity(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    stream = _stream(spark, sf_dir, "events", source.schema)
    events = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    return _streamed(sessions.windowed_activity(events, late="0 seconds", size="1 hour"), "complete").select("start", "kind", "n")


def _stream(spark, sf_dir: str, name: str, schema):
    """A table's files as a stream; a table may be one file, or a folder of them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _streamed(df, mode: str = "append"):
    """What a stream over the files there gives, written by its own sink."""
    spark = df.sparkSession
    top = scratch(spark, "streams")
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{top}/rows").start().awaitTermination()
    else:
        out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{top}/rows")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{top}/rows")


def markdown_report(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
    return writers.markdown_rows(r, ["l_returnflag"], {"mean": 3})


def line_positions(spark, sf_dir):
    r = _regions(spark, sf_dir)
    return r.select("doc_id", F.call_function("instr", "current", F.col("content")).alias("at"), "current").filter("at > 0").select("doc_id", text.line_of_offset(F.col("current"), F.col("at")).cast("bigint").alias("line"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

ORACLE_SQL = {
    "exact_relocate": f"""WITH {_REGIONS_SQL}, x AS (SELECT doc_id, cur, content, CAST((length(cur) - length(replace(cur, content, ''))) // length(content) AS BIGINT) AS places FROM a)
SELECT doc_id, coalesce(places, 0) AS places, CASE WHEN places = 1 THEN CAST(len(string_split(left(cur, CAST(instr(cur, content) - 1 AS BIGINT)), chr(10))) AS BIGINT) END AS exact_start FROM x""",
    "anchor_best_unique": f"""WITH {_REGIONS_SQL}, c AS (SELECT s.doc_id, s.pos AS start_at, e.pos AS end_at, abs(e.pos - s.pos + 1 - s.n) AS span_delta, abs(s.pos + 1 - 2) AS distance FROM p s JOIN p e ON e.doc_id = s.doc_id AND e.pos >= s.pos WHERE s.line = s.first AND e.line = e.last),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_delta, distance, start_at, end_at) AS r, count(*) OVER (PARTITION BY doc_id, span_delta, distance) > 1 AS tied FROM c) SELECT doc_id, start_at, end_at, span_delta, distance, tied FROM q WHERE r = 1""",
    "consensus_votes": f"""WITH {_REGIONS_SQL}, u AS (SELECT doc_id, line, min(pos) AS now FROM p WHERE line <> '' GROUP BY doc_id, line HAVING count(*) = 1), o AS (SELECT doc_id, unnest(range(len(own))) AS pos, unnest(own) AS line, n, len(now) AS m FROM a),
b AS (SELECT *, pos = min(pos) OVER (PARTITION BY doc_id) OR pos = max(pos) OVER (PARTITION BY doc_id) AS edge FROM o WHERE line <> ''),
v AS (SELECT b.doc_id, u.now - b.pos AS start_at, edge FROM b JOIN u USING (doc_id, line) WHERE u.now - b.pos >= 0 AND u.now - b.pos + n <= m), g AS (SELECT doc_id, start_at, count(*) AS support, count(*) FILTER (NOT edge) AS interior FROM v GROUP BY doc_id, start_at)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY support DESC, abs(start_at + 1 - 2), start_at) AS rank FROM g""",
    "symbol_table": """WITH d AS (SELECT doc_id, doc_id % 4 AS k, len(string_split(coalesce(text, ''), chr(10))) AS n, 's' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.txt' ELSE '.ts' END AS path FROM documents)
SELECT path, 'class' AS kind, path || '::C' || doc_id AS qualified_selector, 1 AS start_line, 3 AS end_line, NULL AS error FROM d WHERE k = 0 UNION ALL SELECT path, 'method', path || '::C' || doc_id || '::m', 2, 3, NULL FROM d WHERE k = 0
UNION ALL SELECT path, 'function', path || '::f' || doc_id, 6, 7 + n, NULL FROM d WHERE k = 0 UNION ALL SELECT path, 'function', path || '::g' || doc_id, 1, 3 + n, NULL FROM d WHERE k = 1
UNION ALL SELECT path, NULL, NULL, NULL, NULL, CASE k WHEN 2 THEN 'parser-not-implemented' ELSE 'parse-broken' END FROM d WHERE k > 1""",
    "symbol_resolve": "SELECT CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN doc_id % 4 = 0 THEN 'resolved' ELSE 'unresolved' END AS state, CASE WHEN doc_id % 4 = 0 THEN 'isolated-semantic-engine' ELSE 'isolated-semantic-engine-unresolved' END AS method, CASE WHEN doc_id % 4 = 0 THEN 6 END AS start_line, CASE WHEN doc_id % 4 = 0 THEN 7 + len(string_split(coalesce(text, ''), chr(10))) END AS end_line FROM documents",
    "symbol_pack": """WITH d AS (SELECT doc_id, doc_id || '/symbol-interior/s' || doc_id || '.py::' AS t FROM documents), n AS (SELECT t || 'C' || doc_id AS trace FROM d UNION ALL SELECT t || 'C' || doc_id || '::m' FROM d UNION ALL SELECT t || 'f' || doc_id FROM d)
SELECT trace, c AS capture, 'isolated-semantic-engine' AS method, 1.0 AS recall, 0 AS stale_units, NULL AS error FROM n, (SELECT unnest([0, 1]) AS c)""",
    "stream_tracked": """WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, 'fc_' || left(sha256('src/' || role || chr(0) || 'file' || chr(0) || '1:1'), 16) AS unit_id, 'sha256:' || sha256(text) AS revision FROM conversations),
l AS (SELECT *, lag(revision) OVER (PARTITION BY session, unit_id ORDER BY seq) AS b FROM r)
SELECT session, seq, unit_id, revision, CAST(sum(CASE WHEN b <> revision THEN 1 ELSE 0 END) OVER w AS BIGINT) AS change_count, max(CASE WHEN b IS NULL OR b <> revision THEN seq END) OVER w AS changed_at FROM l WINDOW w AS (PARTITION BY session, unit_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    "stream_delivery": """WITH d AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, CASE WHEN turn % 3 = 0 THEN 'pending' WHEN turn % 2 = 0 THEN 'sent' ELSE 'failed' END AS kind, sha256(text) AS revision FROM conversations),
n AS (SELECT *, first_value(CASE WHEN kind <> 'pending' THEN kind END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x FROM d)
SELECT session, seq, 'u' AS unit_id, revision, CASE x WHEN 'sent' THEN 'committed' ELSE 'discarded' END AS outcome FROM n WHERE kind = 'pending' AND x IS NOT NULL""",
    "stream_activity": "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "markdown_report": """WITH r AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1), b AS (SELECT row_number() OVER (ORDER BY l_returnflag) + 1 AS place, '| ' || l_returnflag || ' | ' || n || ' | ' || printf('%.3f', m) || ' |' AS line FROM r)
SELECT 0 AS place, '| l_returnflag | n | mean |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT * FROM b""",
    "line_positions": f"WITH {_REGIONS_SQL} SELECT doc_id, CAST(len(string_split(left(cur, CAST(instr(cur, content) - 1 AS BIGINT)), chr(10))) AS BIGINT) AS line FROM a WHERE instr(cur, content) > 0",
}
ORACLE_SQL["consensus_start"] = f"WITH v AS ({ORACLE_SQL['consensus_votes']}) SELECT doc_id, start_at, support FROM v WHERE rank = 1 AND support >= 2"
