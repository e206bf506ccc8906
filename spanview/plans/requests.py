"""Whole requests over documents: their sources are sessions, the documents files that were read, some changed or gone by now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bootstrap, ledger, phases, replay, requests
from .selection import _CHOSEN, _FRAME
from .tables import BUDGET, READS_SQL, TASK, TURN, UNITS_SQL, reads, scratch, table, units


def _inputs(spark, sf_dir):
    """(messages, units, files): each document was read by a call, every fourth one earlier too; every sixth is longer now, every 29th gone."""
    u = units(spark, sf_dir)
    files = u.filter("doc_id % 29 > 0").select("session", "path", F.when(F.col("doc_id") % 6 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content")).alias("content"))
    n = F.col("doc_id").cast("string")

    def pair(name: str, at):
        call = F.concat(F.lit(name), n)
        calls, none = F.array(F.struct(call.alias("id"))), F.lit(None).cast("array<struct<id:string>>")
        text, unit = F.lit(None).cast("string"), F.lit(None).cast("string")
        return [
            F.struct(at.alias("seq"), F.lit("assistant").alias("role"), text.alias("text"), calls.alias("tool_calls"), F.lit(None).cast("string").alias("call_id"), unit.alias("unit_id")),
            F.struct((at + 1).alias("seq"), F.lit("tool").alias("role"), F.col("content").alias("text"), none.alias("tool_calls"), call.alias("call_id"), F.col("unit_id").alias("unit_id")),
        ]

    later, early = pair("c", F.col("doc_id") * 2 + 1_000_000_000), pair("o", F.col("doc_id") * 2)
    each = F.when(F.col("doc_id") % 4 == 0, F.array(*early, *later)).otherwise(F.array(*later))
    said = u.groupBy("session").agg(F.min("doc_id").alias("n")).select("session", F.lit(-1).cast("bigint").alias("seq"), F.lit("user").alias("role"), F.lit("please go on").alias("text"))
    return u.select("session", F.inline(each)).unionByName(said, allowMissingColumns=True), u, files


_NOW_SQL = f"""{UNITS_SQL.replace('named AS (', 'was AS (')},
held AS (SELECT * EXCLUDE (content, end_line, state, revision), CASE WHEN doc_id % 6 = 0 AND doc_id % 29 > 0 THEN content || chr(10) || 'more' ELSE content END AS content, end_line AS end_line, content AS before, revision AS revision_before,
         CASE WHEN doc_id % 29 = 0 THEN 'unresolved' ELSE 'resolved' END AS state FROM was),
named AS (SELECT * EXCLUDE (end_line, change_count, changed_at), end_line + CASE WHEN doc_id % 6 = 0 AND doc_id % 29 > 0 THEN 1 ELSE 0 END AS end_line, 'sha256:' || sha256(content) AS revision,
         change_count + CASE WHEN doc_id % 6 = 0 AND doc_id % 29 > 0 THEN 1 ELSE 0 END AS change_count, CASE WHEN doc_id % 6 = 0 AND doc_id % 29 > 0 THEN {TURN} ELSE changed_at END AS changed_at FROM held)
"""
_REQUEST_SQL = f"""{_CHOSEN.replace(UNITS_SQL, _NOW_SQL)},
p AS (SELECT session, list({_FRAME} ORDER BY change_count, unit_id) FILTER (disposition = 'selected') AS f, count(*) FILTER (disposition = 'unresolved') AS u, count(*) FILTER (disposition = 'budget') AS b, count(*) FILTER (disposition = 'selected') AS s,
      bool_and(revision = revision_before) FILTER (disposition = 'selected') AS same FROM chosen GROUP BY session),
t AS (SELECT p.*, array_to_string(list_concat(['<span-context turn="{TURN}" selected="' || len(coalesce(f, [])) || '" unresolved="' || u || '" budget-omitted="' || b || '">' ||
  CASE WHEN len(coalesce(f, [])) > 0 THEN 'Files as they are now. Marks left by earlier reads point to this list.' ELSE '' END], coalesce(f, []), ['</span-context>']), chr(10)) AS text FROM p),
mark AS (SELECT *, '[span:' || unit_id || ' path=' || path || '] Its text as it is now stands in the context below.' AS shown,
         '[span:omitted-read path=' || path || '] ' || CASE WHEN disposition = 'budget' THEN 'Its text did not fit into the budget of this context.' ELSE 'Its text is not part of this context.' END AS left_out FROM chosen)"""


def _digest(built):
    """A request as one row a session: how many messages, their bytes, and a hash of all in order."""
    messages, chosen = built
    line = F.concat("role", F.lit(":"), F.coalesce("text", F.lit("")), F.lit(" "), F.array_join(F.coalesce(F.transform("tool_calls", lambda c: c["id"]), F.array().cast("array<string>")), ","))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.sha2(line, 256).alias("line")))), lambda x: x["line"]), "\n"), 256)
    out = requests.report(messages, chosen, whole.alias("sha256"))
    return out.select(*(c for c in out.columns if c != "sha256"), "sha256")


def request_marks(spark, sf_dir):
    """The next request of each session, where all reads of tracked units become marks."""
    return _digest(requests.built(*_inputs(spark, sf_dir), TASK, TURN, BUDGET))


def request_dispositions(spark, sf_dir):
    """The next request of each session, where the last read of a unit says what became of it, and what was shown before is not shown again."""
    messages, u, files = _inputs(spark, sf_dir)
    return _digest(requests.built(messages, u, files, TASK, TURN, BUDGET, requests.DISPOSITIONS, u.select("session", "unit_id", "revision")))


def phase_runs(spark, sf_dir):
    """A study in four phases over documents and labels, run three times: first, with nothing changed, and with one label less."""
    d, marks = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    study = [
        phases.Phase("freeze", ("documents",), lambda d: d.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))),
        phases.Phase("generate", ("freeze", "documents"), lambda f, d: f.join(d.select("doc_id", F.length("text").alias("chars")), "doc_id")),
        phases.Phase("run", ("generate", "labels"), lambda g, m: g.join(m, "doc_id", "left")),
        phases.Phase("report", ("run",), lambda r: r.groupBy("source").agg(F.count("quality").alias("judged"), F.sum("chars").alias("chars"))),
    ]
    path, least = scratch(spark, "phases"), marks.agg(F.min("doc_id").alias("least"))
    runs = [phases.run(spark, study, {"documents": d, "labels": m}, path) for m in (marks, marks, marks.join(least, F.col("doc_id") == F.col("least"), "left_anti"))]
    out = None
    for i, report in enumerate(runs):
        report = report.select(F.lit(i + 1).alias("run"), "phase", "state", "reason", "rows")
        out = report if out is None else out.unionByName(report)
    return out


def _golds(spark, sf_dir):
    """Units that traces require, one a document: a region by its selector or the file, after edits; every seventh declares another text, every third file is gone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("trace"), F.lit("f").alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    k, initial, none = F.col("trace"), text.line_slice(F.col("t"), F.lit(1), F.lit(2)), F.lit(None).cast("string")
    now = F.when(k % 3 == 0, F.concat(F.lit("new line\n"), F.col("t"))).otherwise(F.col("t"))
    files = d.filter(k % 3 < 2).select("trace", "path", now.alias("content"))
    read = lambda seq, selector, scope: F.struct(F.lit(seq).alias("seq"), selector.alias("selector"), F.lit(scope).alias("scope"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), initial.alias("initial"))
    seen = d.select("trace", "path", F.inline(F.array(read(2, F.lit("s"), "region"), read(1, F.lit("other"), "file"), read(3, none, "file"))))
    declared = F.when(k % 7 == 0, F.lit("other")).when(k % 2 == 1, replay.gold(now, F.lit("region"), F.lit(1), F.lit(2), initial)).otherwise(now)
    required = d.select("trace", "path", F.when(k % 2 == 1, "s").alias("selector"), F.sha2(declared, 256).alias("sha256"))
    return replay.required_gold(required, seen, files)


def required_golds(spark, sf_dir):
    return _golds(spark, sf_dir).select("trace", "scope", F.sha2("gold", 256).alias("gold_sha256"), "error")


def gold_quarantine(spark, sf_dir):
    """How many traces count, and how many are held back for which reason."""
    kept, held = replay.quarantined(_golds(spark, sf_dir))
    reasons = held.groupBy(F.array_join("errors", ",").alias("reason")).agg(F.count("*").alias("traces"))
    return reasons.unionByName(kept.agg(F.lit("none").alias("reason"), F.countDistinct("trace").alias("traces")))


def baseline_reread(spark, sf_dir):
    """Payloads of the system that appends and reads again, one a session of events."""
    rd = reads(spark, sf_dir).select(F.col("session").alias("trace"), "seq", "path", "content")
    files = rd.groupBy("trace", "path").agg(F.max_by("content", "seq").alias("content")).filter("path != 'src/f3.py'")
    out = replay.reread_payloads(rd, rd.select("trace").distinct().withColumn("task", F.lit("go")), files)
    return out.select("trace", F.sha2("payload", 256).alias("payload_sha256"), F.octet_length("payload").cast("bigint").alias("bytes"))


def spend_cached(spark, sf_dir):
    u = reads(spark, sf_dir).select(F.col("kind").alias("arm"), F.col("k").alias("prompt_tokens"), F.when(F.col("seq") % 3 > 0, F.col("seq") % 40).alias("hit_tokens"), F.col("seq").alias("completion_tokens"))
    return ledger.cached_spend(u, 0.014, 0.44, 1.32).withColumn("usd", F.round("usd", 12))


def paired_intervals(spark, sf_dir):
    """Median and 95th percentile of what two systems cost more than a third for the same order, with their intervals."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = F.col("o_totalprice").cast("double")
    arms = {"base": value, "x": value + (F.col("o_custkey") % 7 - 2), "y": value + (k % 1000 - 300) * (k % 3)}
    facts = o.select(k.alias("pair"), F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), v.alias("value")) for a, v in arms.items()))))
    deltas = bootstrap.paired_deltas(facts, "base").withColumn("delta", F.round("delta", 4))
    return bootstrap.quantile_intervals(deltas, samples=100)


QUERIES = {"request_marks": request_marks, "request_dispositions": request_dispositions, "phase_runs": phase_runs, "required_golds": required_golds, "gold_quarantine": gold_quarantine, "baseline_reread": baseline_reread, "spend_cached": spend_cached, "paired_intervals": paired_intervals}

_GOLDS_SQL = """
d AS (SELECT doc_id AS trace, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT *, CASE WHEN trace % 3 = 0 THEN 'new line' || chr(10) || t ELSE t END AS after FROM d), f AS (SELECT *, string_split(after, chr(10)) AS n FROM e),
h AS (SELECT *, list_filter(range(1, len(n) + 1), lambda i: n[i] = l[1]) AS p FROM f),
r AS (SELECT *, CASE WHEN n[1] = l[1] OR len(p) <> 1 THEN array_to_string(n[1:2], chr(10)) ELSE array_to_string(n[p[1]:p[1] + 1], chr(10)) END AS region FROM h),
g AS (SELECT trace, CASE WHEN trace % 2 = 1 THEN 'region' ELSE 'file' END AS scope, CASE WHEN trace % 3 = 2 THEN '' WHEN trace % 2 = 1 THEN region ELSE after END AS gold,
      sha256(CASE WHEN trace % 7 = 0 THEN 'other' WHEN trace % 2 = 1 THEN region ELSE after END) AS declared FROM r),
j AS (SELECT trace, scope, sha256(gold) AS gold_sha256, CASE WHEN gold = '' THEN 'missing' WHEN sha256(gold) <> declared THEN 'mismatch' END AS error FROM g)"""
_TOTALS = """SELECT m.session, count(*) AS messages, CAST(sum(strlen(text)) AS BIGINT) AS payload_bytes, CAST(arg_max(strlen(text), seq) AS BIGINT) AS projection_bytes, any_value(s) AS selected, any_value(u) AS unresolved, any_value(b) AS budget,
       (SELECT max(used) FROM chosen c WHERE c.session = m.session) AS used_chars, sha256(string_agg(sha256(role || ':' || text || ' ' || calls), chr(10) ORDER BY seq)) AS sha256
FROM m JOIN p ON p.session = m.session GROUP BY m.session"""
_SAID = "SELECT DISTINCT session, CAST(-1 AS BIGINT) AS seq, 'user' AS role, 'please go on' AS text, '' AS calls FROM chosen"
_LAST = "(SELECT max(doc_id) * 2 + 1000000002 FROM chosen c WHERE c.session = t.session)"

ORACLE_SQL = {
    "request_marks": f"""{_REQUEST_SQL},
m AS ({_SAID} UNION ALL SELECT session, doc_id * 2 + 1000000000, 'assistant', '', 'c' || doc_id FROM mark UNION ALL SELECT session, doc_id * 2 + 1000000001, 'tool', shown, '' FROM mark
      UNION ALL SELECT session, doc_id * 2, 'assistant', '', 'o' || doc_id FROM mark WHERE doc_id % 4 = 0 UNION ALL SELECT session, doc_id * 2 + 1, 'tool', shown, '' FROM mark WHERE doc_id % 4 = 0
      UNION ALL SELECT session, {_LAST}, 'user', text, '' FROM t)
{_TOTALS}""",
    "request_dispositions": f"""{_REQUEST_SQL},
m AS ({_SAID} UNION ALL SELECT session, doc_id * 2 + 1000000000, 'assistant', '', 'c' || doc_id FROM mark UNION ALL SELECT session, doc_id * 2 + 1000000001, 'tool', CASE WHEN disposition = 'selected' THEN shown ELSE left_out END, '' FROM mark
      UNION ALL SELECT session, {_LAST}, 'user', text, '' FROM t)
{_TOTALS}""",
    "phase_runs": """WITH n AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)) AS m, count(DISTINCT source) + CAST(bool_or(source IS NULL) AS INT) AS s FROM documents),
p AS (SELECT unnest([{'phase': 'freeze', 'rows': n}, {'phase': 'generate', 'rows': n}, {'phase': 'run', 'rows': m}, {'phase': 'report', 'rows': s}]) AS p FROM n)
SELECT run, p.phase AS phase, CASE WHEN run = 1 THEN 'computed' WHEN run = 2 OR p.phase IN ('freeze', 'generate') THEN 'kept' ELSE 'blocked' END AS state,
       CASE WHEN run = 3 AND p.phase = 'run' THEN 'labels changed' WHEN run = 3 AND p.phase = 'report' THEN 'after run' END AS reason, CASE WHEN run = 3 AND p.phase IN ('run', 'report') THEN NULL ELSE p.rows END AS rows FROM p, range(1, 4) r(run)""",
    "required_golds": f"WITH {_GOLDS_SQL} SELECT * FROM j",
    "gold_quarantine": f"WITH {_GOLDS_SQL} SELECT coalesce(error, 'none') AS reason, count(*) AS traces FROM j GROUP BY 1 UNION ALL SELECT 'none', 0 WHERE NOT EXISTS (SELECT 1 FROM j WHERE error IS NULL)",
    "baseline_reread": f"""WITH {READS_SQL}, r AS (SELECT session AS trace, seq, path, content FROM reads), n AS (SELECT trace, path, arg_max(content, seq) AS content, min(seq) AS first FROM r WHERE path <> 'src/f3.py' GROUP BY trace, path),
t AS (SELECT trace, 0 AS part, seq, content FROM r UNION ALL SELECT trace, 1, first, content FROM n), p AS (SELECT trace, string_agg(content, chr(10) || chr(10) ORDER BY part, seq) || chr(10) || chr(10) || 'TASK: go' AS payload FROM t GROUP BY trace)
SELECT trace, sha256(payload) AS payload_sha256, CAST(strlen(payload) AS BIGINT) AS bytes FROM p""",
    "spend_cached": f"""WITH {READS_SQL}, u AS (SELECT kind AS arm, k, seq, least(CASE WHEN seq % 3 > 0 THEN seq % 40 ELSE 0 END, k) AS h FROM reads)
SELECT arm, count(*) AS requests, CAST(sum(h) AS BIGINT) AS hit_tokens, CAST(sum(k - h) AS BIGINT) AS miss_tokens, CAST(sum(seq) AS BIGINT) AS completion_tokens, round((sum(h) * 0.014 + sum(k - h) * 0.44 + sum(seq) * 1.32) / 1e6, 12) AS usd FROM u GROUP BY ROLLUP (arm)""",
    "paired_intervals": """WITH d AS (SELECT 'x' AS arm, o_orderkey AS pair, CAST(o_custkey % 7 - 2 AS DOUBLE) AS delta FROM orders UNION ALL SELECT 'y', o_orderkey, CAST((o_orderkey % 1000 - 300) * (o_orderkey % 3) AS DOUBLE) FROM orders),
s AS (SELECT pair, s, CAST('0x' || substr(md5(pair || ':' || s || ':7'), 1, 8) AS BIGINT) AS u FROM (SELECT DISTINCT pair FROM d), range(1, 101) r(s)),
w AS (SELECT pair, s, CASE WHEN u < 1580030163 THEN 0 WHEN u < 3160060327 THEN 1 WHEN u < 3950075409 THEN 2 WHEN u < 4213413769 THEN 3 WHEN u < 4279248359 THEN 4 WHEN u < 4292415312 THEN 5 WHEN u < 4294609782 THEN 6 ELSE 7 END AS w FROM s),
g AS (SELECT arm, s, delta, sum(w) AS w FROM d JOIN w USING (pair) GROUP BY ALL),
c AS (SELECT arm, s, delta, sum(w) OVER (PARTITION BY arm, s ORDER BY delta) AS c, sum(w) OVER (PARTITION BY arm, s) AS t FROM g),
f AS (SELECT arm, s, q AS quantile, min(delta) AS value FROM c, (SELECT unnest([0.5, 0.95]) AS q) WHERE t > 0 AND c.c >= greatest(1, ceil(round(q * t, 9))) GROUP BY ALL),
b AS (SELECT arm, quantile, list_sort(list(value)) AS l FROM f GROUP BY ALL), v AS (SELECT arm, list_sort(list(delta)) AS l FROM d GROUP BY arm)
SELECT b.arm, CAST(quantile AS DOUBLE) AS quantile, v.l[CAST(greatest(1, ceil(len(v.l) * quantile)) AS BIGINT)] AS value, b.l[CAST(greatest(1, ceil(round(len(b.l) * 0.025, 9))) AS BIGINT)] AS low, b.l[CAST(greatest(1, ceil(round(len(b.l) * 0.975, 9))) AS BIGINT)] AS high FROM b JOIN v ON v.arm = b.arm""",
}
