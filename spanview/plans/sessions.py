"""Sessions over events and conversations: registry, refresh, transcripts and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, registry, relocate, shell_reads
from .tables import READS_SQL, reads, table


def _units(spark, sf_dir):
    return registry.current_units(reads(spark, sf_dir))


def _dispositions(spark, sf_dir):
    """Each unit's fate this turn, from its counters."""
    u = _units(spark, sf_dir)
    kind = F.when(F.col("change_count") % 3 == 0, "selected").when(F.col("change_count") % 3 == 1, "budget").otherwise("unresolved")
    return u.select("session", "unit_id", "path", kind.alias("disposition"))


def _calls(spark, sf_dir):
    return registry.identified(reads(spark, sf_dir)).select("session", "seq", "call_id", "unit_id", "path", "kind", "k")


def registry_upsert(spark, sf_dir):
    return registry.tracked(reads(spark, sf_dir)).select("event_id", "unit_id", "revision", "change_count", "changed_at", "pinned")


def registry_current(spark, sf_dir):
    return _units(spark, sf_dir).select("session", "unit_id", "revision", "observed_at", "change_count", "changed_at", "pinned")


def registry_versions(spark, sf_dir):
    return registry.versions(reads(spark, sf_dir)).select("session", "unit_id", "revision", "content", "observed_at")


def recover_revision(spark, sf_dir):
    r = reads(spark, sf_dir)
    wanted = registry.identified(r).select("session", "unit_id", F.when(F.col("k") % 2 == 0, F.col("revision")).alias("revision")).distinct()
    return registry.recovered(wanted, registry.current_units(r), registry.versions(r)).select("session", "unit_id", "revision", "content", "observed_at").distinct()


def mark_used(spark, sf_dir):
    used = _calls(spark, sf_dir).filter("kind = 'purchase'").select("session", "unit_id", F.col("seq").alias("turn"))
    return registry.marked_used(_units(spark, sf_dir).withColumn("last_used_at", F.lit(0).cast("bigint")), used).select("session", "unit_id", "last_used_at")


def active_set_sync(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("active", F.col("kind") == "click")
    return registry.active(_units(spark, sf_dir), calls).select("session", "unit_id")


def latest_read_per_observation(spark, sf_dir):
    return registry.latest_by_observation(reads(spark, sf_dir))


def refresh_asof(spark, sf_dir):
    r = reads(spark, sf_dir)
    writes = r.filter("kind not in ('view', 'purchase')").select("session", "path", "seq", "content", (F.col("k") % 17 == 0).alias("deleted"))
    captures = r.filter("kind = 'purchase'").select("session", F.col("event_id").alias("capture"), "seq")
    return registry.files_as_of(writes, captures)


def refresh_counters(spark, sf_dir):
    u = _units(spark, sf_dir).select("session", "unit_id", "path", "scope", "selector", "content", "revision", "start_line", "end_line", "change_count", "changed_at", F.lit(None).cast("int").alias("file_lines"))
    files = u.groupBy("session", "path").agg(F.max("content").alias("content"))
    found = relocate.relocated(u.filter("scope = 'file'"), files)
    out = relocate.refreshed(u, found, 10_000)
    return out.select("session", "unit_id", "state", "method", "revision", "change_count", "changed_at")


def marker_rewrite(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text", F.concat(F.lit("u"), (F.col("turn") % 5).cast("string")).alias("unit_id"))
    u = c.filter("seq % 3 = 0").select("session", "unit_id", F.concat(F.lit("src/"), "unit_id", F.lit(".py")).alias("path")).distinct()
    return history.rewritten(c, u).select("session", "seq", F.sha2("text", 256).alias("text_sha256"))


def text_flatten(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.when(F.col("turn") % 2 == 0, "image").otherwise("text").alias("type"), F.col("role").alias("text")))
    return c.select("conv_id", "turn", F.sha2(history.flattened(parts), 256).alias("flat"), F.sha2(history.text_only(parts), 256).alias("only"))


def tool_call_extract(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    call = F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.lit("read").alias("name"), F.lit("{}").alias("arguments"))
    part = F.struct(F.lit("toolCall").alias("type"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("id"), F.lit("bash").alias("name"), F.lit("{}").alias("arguments"))
    m = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", F.array(part).alias("parts"), F.when(F.col("turn") % 4 == 1, F.array(call)).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("tool_calls"))
    return history.tool_calls(m).select("session", "seq", "call_id", "tool")


def served_calls(spark, sf_dir):
    return history.served_calls(_calls(spark, sf_dir), _dispositions(spark, sf_dir)).select("session", "call_id")


def unserved_calls(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return history.unserved_calls(calls, calls.filter("kind != 'view'"), history.served_calls(calls, _dispositions(spark, sf_dir)))


def call_disposition(spark, sf_dir):
    return history.call_dispositions(_calls(spark, sf_dir).drop("path"), _dispositions(spark, sf_dir))


def disposition_by_path(spark, sf_dir):
    return history.path_dispositions(_dispositions(spark, sf_dir))


def omitted_markers(spark, sf_dir):
    return _dispositions(spark, sf_dir).filter("disposition != 'selected'").select("session", "unit_id", history.omitted_marker(F.col("path"), F.col("disposition")).alias("marker"))


def dump_markers(spark, sf_dir):
    p = history.path_dispositions(_dispositions(spark, sf_dir)).filter("path in ('src/f1.py', 'src/f2.py')")
    by = p.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("path", "disposition"))).alias("l"))
    untracked = F.when(F.col("session") % 2 == 0, F.array(F.lit("x.txt"))).otherwise(F.array().cast("array<string>"))
    return by.select("session", history.dump_marker(F.transform("l", lambda x: x["path"]), F.transform("l", lambda x: x["disposition"]), untracked).alias("marker"))


def prune_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    call = F.concat(F.lit("t"), F.floor(F.col("turn") / 2).cast("string"))
    m = c.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 1, "tool").otherwise("assistant").alias("role"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("turn") % 2 == 0, F.array(F.struct(call.alias("id")))).otherwise(F.array().cast("array<struct<id:string>>")).alias("tool_calls"), F.when(F.col("turn") % 2 == 1, call).alias("call_id"),
    )
    results = m.filter("role = 'tool'")
    dropped = results.filter("session % 2 = 0 and seq % 3 = 0").select("session", "call_id")
    replaced = results.filter("seq % 5 = 0").select("session", "call_id", F.lit("[gone]").alias("marker"))
    return history.pruned(m, dropped, replaced).select("session", "seq", F.size("tool_calls").cast("bigint").alias("calls"), F.sha2("text", 256).alias("text_sha256"))


def collapse_history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    whole = F.concat(F.lit('<span-context turn="1">\n<span-unit id="a" content-bytes="'), F.octet_length("text").cast("string"), F.lit('">\n'), F.col("text"), F.lit("\n</span-unit>\n</span-context>"))
    m = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", F.when(F.col("turn") % 2 == 0, whole).otherwise(F.col("text")).alias("text"))
    return history.collapsed_history(m).select("session", "seq", F.sha2("text", 256).alias("text_sha256"))


def collapse_decision(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 100).alias("session"), "role", "text")
    u = _units(spark, sf_dir)
    chosen = u.select("session", "unit_id", "revision", "scope", F.lit("exact").alias("method"), F.when(F.col("change_count") < 40, "selected").otherwise("budget").alias("disposition"))
    injected = u.filter("session % 3 != 0").select("session", "unit_id", "revision")
    return history.collapse_decisions(c, chosen, injected)


def inline_read(spark, sf_dir):
    r = registry.identified(reads(spark, sf_dir))
    req = r.groupBy("session").agg((F.count("*") % 4).alias("users"), (F.max("k") % 2 == 0).alias("replied"), (F.min("k") % 3).alias("injected"), F.lit(0).alias("skipped"), F.count("*").alias("selected"), F.lit(0).alias("omitted"))
    req = req.withColumn("projection", F.when(F.col("session") % 2 == 0, "<span-unit id").otherwise("")).withColumn("unit_bytes", F.when(F.col("session") % 4 == 0, 5).otherwise(0))
    results = r.select("session", "call_id", "unit_id", "path", F.lit("v3").alias("observed"), "content", F.lit("selected").alias("disposition"), F.when(F.col("k") % 6 == 0, "budget").alias("historical"))
    return history.inlined(results, history.inline_decisions(req)).select("session", "call_id", "text")


def scope_inference(spark, sf_dir):
    k = F.col("k")
    s = history.scope_of(F.col("path"), F.when(k % 3 > 0, k % 9 + 1), F.when(k % 4 == 1, k % 5 + 1), F.when(k % 4 == 2, k % 9 + 3), F.when(k % 11 == 0, "sym"), F.lit(9))
    return reads(spark, sf_dir).select("event_id", s.alias("s")).select("event_id", "s.scope", F.col("s.start_line").cast("bigint").alias("start_line"), F.col("s.end_line").cast("bigint").alias("end_line"))


def merge_tracked(spark, sf_dir):
    r = reads(spark, sf_dir).select("session", "call_id", "path", "content", F.when(F.col("k") % 2 == 0, F.col("start_line")).alias("start_line"), "end_line", F.lit(None).cast("int").alias("file_lines"), F.lit(None).cast("string").alias("selector"), F.lit(None).cast("int").alias("tail_lines"), "k", "kind")
    previous = r.filter("k % 2 = 0").withColumns({"file_lines": F.lit(9), "content": F.lit("old")}).drop("k", "kind")
    return history.merged_tracked(previous, r.filter("kind != 'view'").drop("k", "kind")).select("session", "call_id", "content", "start_line", "file_lines")


def tail_fail_close(spark, sf_dir):
    k = F.col("k")
    t = reads(spark, sf_dir).select("event_id", (k % 3).alias("tail_lines"), F.lit(9).alias("file_lines"), (k % 2 + 8).alias("lines_now"), F.lit(7).alias("start_line"), (k % 5 + 5).alias("start_now"), (k % 19 == 0).alias("invalid_tail"))
    return history.tail_failures(t).select("event_id", "failure")


def pairing_check(spark, sf_dir):
    r = reads(spark, sf_dir)
    calls = r.filter("kind = 'view'").select("session", "seq", F.concat(F.lit("x"), F.col("k").cast("string")).alias("call_id"))
    results = r.filter("kind = 'click'").select("session", "seq", F.concat(F.lit("x"), F.col("k").cast("string")).alias("call_id"))
    return history.pairing_errors(calls, results)


def delivery_ack(spark, sf_dir):
    kind = F.when(F.col("k") % 4 == 0, "sent").when(F.col("k") % 4 == 1, "failed").otherwise("pending")
    d = registry.identified(reads(spark, sf_dir)).select("session", "seq", kind.alias("kind"), "unit_id", "revision")
    return history.acknowledged(d)


def shell_parse(spark, sf_dir):
    k = F.col("k").cast("string")
    r = reads(spark, sf_dir)
    command = (
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("cat "), "path")).when(F.col("k") % 6 == 1, F.concat(F.lit("head -n "), (F.col("k") + 1).cast("string"), F.lit(" "), "path"))
        .when(F.col("k") % 6 == 2, F.concat(F.lit("sed -n '2,"), (F.col("k") + 2).cast("string"), F.lit("p' "), "path")).when(F.col("k") % 6 == 3, F.concat(F.lit("bash -lc \"tail -"), (F.col("k") + 1).cast("string"), F.lit(" "), "path", F.lit('"')))
        .when(F.col("k") % 6 == 4, F.concat(F.lit("cat "), "path", F.lit(" | wc -l"))).otherwise(F.concat(F.lit("nl a.py "), "path", F.lit(" -b"), k))
    )
    out = shell_reads.parsed(r.select("event_id", command.alias("command")))
    return out.select("event_id", "read.path", "read.scope", "read.start_line", "read.end_line", "read.tail_lines", F.size("dumped").cast("bigint").alias("dumped"))


def shell_stale_dumps(spark, sf_dir):
    r = reads(spark, sf_dir)
    commands = r.select("session", "call_id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("cat x.txt "), "path")).otherwise(F.concat(F.lit("grep a "), "path")).alias("command"))
    tracked = r.filter("path in ('src/f0.py', 'src/f1.py', 'src/f2.py')").select("session", "path").distinct()
    out = shell_reads.stale_dumps(commands, tracked)
    return out.select("session", "call_id", F.array_join("paths", ",").alias("paths"), F.array_join("untracked", ",").alias("untracked"))


def shell_observed_span(spark, sf_dir):
    r = shell_reads.parsed(reads(spark, sf_dir).select("event_id", "k", F.concat(F.when(F.col("k") % 2 == 0, "head -n 2").otherwise("tail -n 2"), F.lit(" f")).alias("command")))
    seen = F.when(F.col("k") % 3 == 0, F.lit("a\nb\n")).when(F.col("k") % 3 == 1, "b\nc\n").otherwise("a\n")
    out = shell_reads.observed_spans(r.withColumns({"file_text": F.lit("a\nb\nc\n"), "seen": seen}))
    return out.select("event_id", "span.start_line", "span.end_line")


def request_pipeline(spark, sf_dir):
    """History rewriting and the appended projection, as bytes of a request."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text", F.concat(F.lit("u"), (F.col("turn") % 5).cast("string")).alias("unit_id"))
    u = c.filter("seq % 3 = 0").select("session", "unit_id", F.concat(F.lit("src/"), "unit_id", F.lit(".py")).alias("path")).distinct()
    out = history.rewritten(c, u)
    return out.groupBy("session").agg(F.count("*").alias("messages"), F.sum(F.octet_length("text")).alias("bytes"), F.max_by("role", "seq").alias("last_role"))


def observation_discovery(spark, sf_dir):
    r = reads(spark, sf_dir)
    calls = r.select("session", "call_id", F.when(F.col("k") % 2 == 0, "read").otherwise("write").alias("tool"), F.lit("{}").alias("arguments"))
    results = r.filter("kind != 'view'").select("session", "call_id", F.col("content").alias("text"))
    executed = r.filter("kind = 'click'").select("session", "call_id", F.lit('{"x":1}').alias("arguments"))
    return history.observed_calls(calls, results, executed, ("read",)).select("session", "call_id", "arguments", "text")


def seed_filter(spark, sf_dir):
    r = reads(spark, sf_dir).select("event_id", F.when(F.col("k") % 5 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("k") % 7 == 0, F.repeat(F.lit("x"), 600)).otherwise(F.col("content")).alias("content"))
    return history.seeded(r, 512).select("event_id")


def fail_open_envelope(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")

    def transform(pdf):
        if pdf["session"].iloc[0] % 3 == 0:
            raise KeyError("no")
        return pdf.assign(text="x").iloc[: len(pdf) - (pdf["session"].iloc[0] % 3 == 1)]

    return history.fail_open(c, transform).select("session", "seq", F.sha2("text", 256).alias("text_sha256"), "applied")


def shell_discovery(spark, sf_dir):
    r = reads(spark, sf_dir)
    arguments = F.concat(F.lit('{"'), F.when(F.col("k") % 2 == 0, "command").otherwise("cmd"), F.lit('": "cat '), "path", F.when(F.col("k") % 5 == 0, " | wc").otherwise(""), F.lit('"}'))
    calls = r.select("session", "call_id", arguments.alias("arguments"))
    return shell_reads.discovered(calls, r.filter("kind != 'view'")).select("session", "call_id", "path", "scope")


_TRACKED = f"""{READS_SQL}, stepped AS (SELECT *, lag(revision) OVER (PARTITION BY session, unit_id ORDER BY turn, seq) AS before FROM identified),
tracked AS (
  SELECT *, CAST(sum(CASE WHEN before IS NOT NULL AND before <> revision THEN 1 ELSE 0 END) OVER w AS BIGINT) AS change_count, max(CASE WHEN before IS NULL OR before <> revision THEN turn END) OVER w AS changed_at, bool_or(pinned) OVER w AS pin
  FROM stepped WINDOW w AS (PARTITION BY session, unit_id ORDER BY turn, seq ROWS UNBOUNDED PRECEDING)),
cur AS (SELECT session, unit_id, arg_max(revision, turn) AS revision, max(turn) AS observed_at, arg_max(change_count, turn) AS change_count, arg_max(changed_at, turn) AS changed_at, bool_or(pin) AS pinned, arg_max(path, turn) AS path, arg_max(scope, turn) AS scope, arg_max(content, turn) AS content FROM tracked GROUP BY session, unit_id),
ver AS (SELECT session, unit_id, revision, arg_max(content, turn) AS content, max(turn) AS observed_at FROM identified GROUP BY session, unit_id, revision),
disp AS (SELECT session, unit_id, path, CASE change_count % 3 WHEN 0 THEN 'selected' WHEN 1 THEN 'budget' ELSE 'unresolved' END AS disposition FROM cur)"""
_PATHS = f"{_TRACKED}, pd AS (SELECT session, path, arg_min(disposition, CASE disposition WHEN 'selected' THEN 0 WHEN 'unresolved' THEN 1 ELSE 2 END) AS disposition FROM disp GROUP BY session, path)"

def pairing_order(spark, sf_dir):
    """Sessions whose views or clicks no longer follow each other as captured: some calls have changed places with their neighbours."""
    r = reads(spark, sf_dir)
    rows = r.select("session", "seq", F.when(F.col("kind") == "view", "call").otherwise("result").alias("kind"), "call_id", "k")
    moved = F.when(F.col("session") % 3 == 0, F.col("seq") + F.when(F.col("k") % 13 == 0, 3).otherwise(0)).otherwise(F.col("seq"))
    return history.order_changes(rows.withColumn("seq", moved), rows)


def request_facts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text_of = F.when((F.col("conv_id") % 5 == 0) & (F.col("role") == "assistant"), " ").otherwise(F.col("text"))
    return history.request_facts(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", text_of.alias("text")))


def delivery_promotion(spark, sf_dir):
    """A projection is pending in every conversation: the text of its first turn, or one that no message has, after a turn that its number names."""
    c = table(spark, sf_dir, "conversations")
    m = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text", F.lit(0).alias("calls"))
    first = c.groupBy(F.col("conv_id").alias("session")).agg(F.min_by("text", "turn").alias("first"))
    pending = first.select("session", F.when(F.col("session") % 3 == 0, F.col("first")).otherwise(F.lit("none")).alias("projection"), F.when(F.col("session") % 2 == 0, F.col("session") % 4).alias("after_user"))
    return history.promoted(pending, m).select("session", "after_user", "outcome")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

ORACLE_SQL = {
    "registry_upsert": f"WITH {_TRACKED} SELECT event_id, unit_id, revision, change_count, changed_at, pin AS pinned FROM tracked",
    "registry_current": f"WITH {_TRACKED} SELECT session, unit_id, revision, observed_at, change_count, changed_at, pinned FROM cur",
    "registry_versions": f"WITH {_TRACKED} SELECT * FROM ver",
    "recover_revision": f"""WITH {_TRACKED}, w AS (SELECT DISTINCT session, unit_id, CASE WHEN k % 2 = 0 THEN revision END AS revision FROM identified),
n AS (SELECT DISTINCT w.session, w.unit_id, coalesce(w.revision, c.revision) AS revision FROM w JOIN cur c USING (session, unit_id)) SELECT v.* FROM ver v JOIN n USING (session, unit_id, revision)""",
    "mark_used": f"WITH {_TRACKED} SELECT session, unit_id, coalesce((SELECT max(seq) FROM identified i WHERE i.session = c.session AND i.unit_id = c.unit_id AND kind = 'purchase'), 0) AS last_used_at FROM cur c",
    "active_set_sync": f"WITH {_TRACKED} SELECT session, unit_id FROM cur SEMI JOIN (SELECT session, unit_id FROM identified WHERE kind = 'click') USING (session, unit_id)",
    "latest_read_per_observation": f"""WITH {READS_SQL}, o AS (SELECT *, CASE WHEN scope = 'region' THEN 'region:' || path || ':' || start_line || ':' || end_line ELSE 'file:' || path END AS observation FROM reads)
SELECT session, observation, arg_max(call_id, seq) AS call_id FROM o GROUP BY session, observation""",
    "refresh_asof": f"""WITH {READS_SQL}, w AS (SELECT session, path, seq, content, k % 17 = 0 AS deleted FROM reads WHERE kind NOT IN ('view', 'purchase')), c AS (SELECT session, event_id AS capture, seq FROM reads WHERE kind = 'purchase')
SELECT c.session, c.capture, w.path, arg_max({{'c': CASE WHEN deleted THEN NULL ELSE content END}}, w.seq).c AS content FROM c JOIN w ON w.session = c.session AND w.seq <= c.seq GROUP BY 1, 2, 3""",
    "refresh_counters": f"""WITH {_TRACKED}, f AS (SELECT session, path, max(content) AS now FROM cur GROUP BY session, path),
r AS (SELECT c.*, 'sha256:' || sha256(f.now) AS nr FROM cur c JOIN f USING (session, path) WHERE scope = 'file')
SELECT session, unit_id, 'resolved' AS state, 'whole-file' AS method, nr AS revision, change_count + CASE WHEN nr <> revision THEN 1 ELSE 0 END AS change_count, CASE WHEN nr <> revision THEN 10000 ELSE changed_at END AS changed_at FROM r""",
    "marker_rewrite": """WITH k AS (SELECT DISTINCT conv_id, 'u' || (turn % 5) AS u FROM conversations WHERE turn % 3 = 0)
SELECT c.conv_id AS session, c.turn AS seq, sha256(CASE WHEN k.u IS NOT NULL THEN '[span:' || k.u || ' path=src/' || k.u || '.py] Its text as it is now stands in the context below.' ELSE text END) AS text_sha256
FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.u = 'u' || (c.turn % 5)""",
    "text_flatten": """SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || role END) AS flat, CASE WHEN turn % 2 <> 0 THEN sha256(text || chr(10) || role) END AS only FROM conversations""",
    "tool_call_extract": "SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 4 = 1 THEN 't' ELSE 'p' END || turn AS call_id, CASE WHEN turn % 4 = 1 THEN 'read' ELSE 'bash' END AS tool FROM conversations WHERE role = 'assistant'",
    "served_calls": f"WITH {_TRACKED} SELECT session, call_id FROM identified SEMI JOIN (SELECT * FROM disp WHERE disposition <> 'budget') d USING (session, unit_id)",
    "unserved_calls": f"WITH {_TRACKED} SELECT DISTINCT session, call_id FROM identified JOIN disp USING (session, unit_id) WHERE kind <> 'view' AND disposition = 'budget'",
    "call_disposition": f"WITH {_TRACKED} SELECT i.session, call_id, d.path, disposition FROM identified i JOIN disp d USING (session, unit_id)",
    "disposition_by_path": f"WITH {_PATHS} SELECT * FROM pd",
    "omitted_markers": f"""WITH {_TRACKED} SELECT session, unit_id, '[span:omitted-read path=' || path || '] ' || CASE disposition WHEN 'budget' THEN 'Its text did not fit into the budget of this context.' ELSE 'Its text is not part of this context.' END AS marker
FROM disp WHERE disposition <> 'selected'""",
    "dump_markers": f"""WITH {_PATHS}, s AS (SELECT session, list(path ORDER BY path) AS p, list(disposition ORDER BY path) AS d FROM pd WHERE path IN ('src/f1.py', 'src/f2.py') GROUP BY session)
SELECT session, CASE WHEN len(p) = 1 THEN '[span:stale-dump path=' || p[1] || '] ' || CASE d[1] WHEN 'selected' THEN 'Its text as it is now stands in the context below.' WHEN 'budget' THEN 'Its text did not fit into the budget of this context.' ELSE 'Its text is not shown, as the unit has not been found again.' END
  ELSE '[span:stale-dump paths=' || array_to_string(p, ', ') || '] What the context has of each path: ' || p[1] || '=' || d[1] || '; ' || p[2] || '=' || d[2] || '.' END || CASE WHEN session % 2 = 0 THEN ' Paths named there that nobody tracks: x.txt.' ELSE '' END AS marker FROM s""",
    "prune_pairs": """WITH m AS (SELECT conv_id AS session, turn AS seq, 't' || (turn // 2) AS call, turn % 2 = 1 AS tool, CASE WHEN turn % 4 = 0 THEN '' ELSE text END AS text FROM conversations),
r AS (SELECT session, call, seq FROM m WHERE tool), rep AS (SELECT session, call FROM r WHERE seq % 5 = 0),
gone AS (SELECT session, call FROM r WHERE session % 2 = 0 AND seq % 3 = 0 AND (session, call) NOT IN (SELECT (session, call) FROM rep)),
j AS (SELECT m.*, g.call IS NOT NULL AS is_gone, rep.call IS NOT NULL AS is_rep FROM m LEFT JOIN gone g ON g.session = m.session AND g.call = m.call LEFT JOIN rep ON rep.session = m.session AND rep.call = m.call)
SELECT session, seq, CAST(CASE WHEN tool OR is_gone THEN 0 ELSE 1 END AS BIGINT) AS calls, sha256(CASE WHEN tool AND is_rep THEN '[gone]' ELSE text END) AS text_sha256 FROM j WHERE NOT (tool AND is_gone) AND NOT (NOT tool AND is_gone AND trim(text) = '')""",
    "collapse_history": """SELECT conv_id AS session, turn AS seq, sha256(CASE WHEN role = 'user' AND turn % 2 = 0 THEN '[span:already-served units=1] An older context stood here; the newest one follows below.'
  WHEN turn % 2 = 0 THEN '<span-context turn="1">' || chr(10) || '<span-unit id="a" content-bytes="' || strlen(text) || '">' || chr(10) || text || chr(10) || '</span-unit>' || chr(10) || '</span-context>' ELSE text END) AS text_sha256 FROM conversations""",
    "collapse_decision": f"""WITH {_TRACKED}, s AS (SELECT conv_id % 100 AS session, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY 1),
u AS (SELECT session, count(*) AS n, count(*) FILTER (session % 3 <> 0) AS same FROM cur WHERE change_count < 40 GROUP BY session)
SELECT s.session, users > 1 AND coalesce(n, 0) > 0 AND coalesce(n, 0) = coalesce(same, 0) AS collapse FROM s LEFT JOIN u USING (session)""",
    "inline_read": f"""WITH {READS_SQL}, q AS (SELECT session, count(*) % 4 AS users, max(k) % 2 = 0 AS replied, min(k) % 3 AS injected FROM identified GROUP BY session),
d AS (SELECT *, users = 2 AND replied AND injected > 0 AND session % 2 = 0 AS first_new, session % 4 = 0 AS quoteable FROM q)
SELECT i.session, call_id, CASE WHEN (length(content) > 0 AND CASE WHEN first_new THEN 'v3' <> content ELSE NOT quoteable END) OR (k % 6 = 0 AND users > 1 AND NOT quoteable) THEN content
  ELSE '[span:' || unit_id || ' path=' || path || '] Its text as it is now stands in the context below.' END AS text FROM identified i JOIN d USING (session)""",
    "scope_inference": f"""WITH {READS_SQL}, a AS (SELECT event_id, CASE WHEN k % 3 > 0 THEN k % 9 + 1 END AS s, CASE WHEN k % 4 = 1 THEN k % 5 + 1 END AS l, CASE WHEN k % 4 = 2 THEN k % 9 + 3 END AS e, k % 11 = 0 AS sym FROM reads),
b AS (SELECT *, coalesce(e, CASE WHEN l IS NOT NULL THEN coalesce(s, 1) + l - 1 END) AS last FROM a),
c AS (SELECT *, CASE WHEN sym THEN 'symbol' WHEN (s IS NULL AND last IS NULL) OR (coalesce(s, 1) <= 1 AND last >= 9) THEN 'file' ELSE 'region' END AS scope FROM b)
SELECT event_id, scope, CASE WHEN scope = 'region' THEN coalesce(s, 1) END AS start_line, CASE WHEN scope = 'region' THEN least(coalesce(last, 9), 9) END AS end_line FROM c""",
    "merge_tracked": f"""WITH {READS_SQL} SELECT session, call_id, CASE WHEN kind <> 'view' THEN content ELSE 'old' END AS content, CASE WHEN k % 2 = 0 THEN 1 END AS start_line, CASE WHEN k % 2 = 0 THEN 9 END AS file_lines FROM reads WHERE k % 2 = 0 OR kind <> 'view'""",
    "tail_fail_close": f"WITH {READS_SQL} SELECT event_id, CASE WHEN k % 19 = 0 THEN 'tail-lines-invalid-observation' WHEN k % 3 > 0 AND k % 2 + 8 <> 9 AND k % 5 + 5 <> 7 THEN 'tail-lines-line-count-shift' END AS failure FROM reads",
    "pairing_check": f"""WITH {READS_SQL}, c AS (SELECT session, k, count(*) AS n, min(seq) AS at FROM reads WHERE kind = 'view' GROUP BY session, k), r AS (SELECT session, k, count(*) AS n, min(seq) AS at FROM reads WHERE kind = 'click' GROUP BY session, k),
j AS (SELECT coalesce(c.session, r.session) AS session, CASE WHEN c.n > 1 THEN '1:duplicate-call' WHEN c.n IS NULL THEN '2:result-without-call' WHEN r.n > 1 THEN '3:duplicate-result' WHEN r.n IS NULL THEN '4:call-without-result' WHEN r.at <= c.at THEN '5:result-before-call' END AS e
FROM c FULL JOIN r ON r.session = c.session AND r.k = c.k) SELECT session, substr(min(e), 3) AS error FROM j GROUP BY session""",
    "delivery_ack": f"""WITH {READS_SQL}, d AS (SELECT session, seq, unit_id, revision, CASE k % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'pending' END AS kind FROM identified),
n AS (SELECT *, first_value(CASE WHEN kind <> 'pending' THEN kind END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM d)
SELECT session, seq, unit_id, revision, CASE WHEN nxt = 'sent' THEN 'committed' WHEN nxt IS NOT NULL THEN 'discarded' ELSE 'pending' END AS outcome FROM n WHERE kind = 'pending'""",
    "shell_parse": f"""WITH {READS_SQL} SELECT event_id, CASE WHEN k % 6 < 4 THEN path END AS path, CASE k % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'region' WHEN 2 THEN 'region' WHEN 3 THEN 'region' END AS scope,
CASE k % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS start_line, CASE k % 6 WHEN 1 THEN k + 1 WHEN 2 THEN k + 2 END AS end_line, CASE k % 6 WHEN 3 THEN k + 1 END AS tail_lines, CAST(CASE WHEN k % 6 = 5 THEN 2 ELSE 0 END AS BIGINT) AS dumped FROM reads""",
    "shell_stale_dumps": f"""WITH {READS_SQL}, t AS (SELECT DISTINCT session, path FROM reads WHERE path IN ('src/f0.py', 'src/f1.py', 'src/f2.py'))
SELECT r.session, call_id, path AS paths, CASE WHEN k % 2 = 0 THEN 'x.txt' ELSE '' END AS untracked FROM reads r SEMI JOIN t USING (session, path)""",
    "shell_observed_span": f"""WITH {READS_SQL} SELECT event_id, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 1 WHEN k % 2 = 1 AND k % 3 = 1 THEN 2 END AS start_line, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 2 WHEN k % 2 = 1 AND k % 3 = 1 THEN 4 END AS end_line FROM reads""",
    "request_pipeline": """WITH k AS (SELECT DISTINCT conv_id, 'u' || (turn % 5) AS u FROM conversations WHERE turn % 3 = 0),
r AS (SELECT c.conv_id, c.turn, role, CASE WHEN k.u IS NOT NULL THEN '[span:' || k.u || ' path=src/' || k.u || '.py] Its text as it is now stands in the context below.' ELSE text END AS t FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.u = 'u' || (c.turn % 5))
SELECT conv_id AS session, count(*) AS messages, CAST(sum(strlen(t)) AS BIGINT) AS bytes, arg_max(role, turn) AS last_role FROM r GROUP BY conv_id""",
    "observation_discovery": f"WITH {READS_SQL} SELECT session, call_id, CASE WHEN kind = 'click' THEN '{{\"x\":1}}' ELSE '{{}}' END AS arguments, content AS text FROM reads WHERE k % 2 = 0 AND kind <> 'view'",
    "seed_filter": f"WITH {READS_SQL} SELECT event_id FROM reads WHERE k % 5 <> 0 AND k % 7 <> 0",
    "fail_open_envelope": "SELECT conv_id AS session, turn AS seq, sha256(CASE WHEN conv_id % 3 = 2 THEN 'x' ELSE text END) AS text_sha256, conv_id % 3 = 2 AS applied FROM conversations",
    "shell_discovery": f"WITH {READS_SQL} SELECT session, call_id, path, 'file' AS scope FROM reads WHERE kind <> 'view' AND k % 5 <> 0",
}

ORACLE_SQL |= {
    "pairing_order": f"""WITH {READS_SQL}, a AS (SELECT session, seq, CASE WHEN kind = 'view' THEN 'call' ELSE 'result' END AS kind, call_id, seq + CASE WHEN session % 3 = 0 AND k % 13 = 0 THEN 3 ELSE 0 END AS moved FROM reads),
n AS (SELECT session, kind, call_id, row_number() OVER (PARTITION BY session, kind ORDER BY moved, call_id) AS p FROM a), t AS (SELECT session, kind, call_id, row_number() OVER (PARTITION BY session, kind ORDER BY seq, call_id) AS p FROM a)
SELECT n.session, min(n.kind) || '-order-changed' AS error FROM n JOIN t ON t.session = n.session AND t.kind = n.kind AND t.p = n.p WHERE n.call_id <> t.call_id GROUP BY n.session""",
    "request_facts": """WITH u AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND role = 'assistant' THEN ' ' ELSE text END AS t, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id AS session, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'user') > 1 AND count(*) FILTER (role = 'assistant' AND n = 1 AND trim(coalesce(t, '')) <> '') > 0 AS replied FROM u GROUP BY conv_id""",
    "delivery_promotion": """WITH p AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN arg_min(text, turn) ELSE 'none' END AS projection, CASE WHEN conv_id % 2 = 0 THEN conv_id % 4 END AS a FROM conversations GROUP BY conv_id)
SELECT conv_id AS session, a AS after_user, CASE WHEN EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = p.conv_id AND role = 'user' AND text = projection) OR EXISTS (SELECT 1 FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn > u.turn AND r.role = 'assistant' AND trim(coalesce(r.text, '')) <> ''
  WHERE u.conv_id = p.conv_id AND u.turn = a AND u.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = u.conv_id AND x.role = 'user' AND x.turn > u.turn AND x.turn < r.turn)) THEN 'committed' ELSE 'discarded' END AS outcome FROM p""",
}
