"""Measures, reports, ledgers, boards and provenance over documents, benchmark, events and facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.numbers import estimated_tokens
from ..operators import ledger, metrics, provenance, replay
from ..sources import readers
from .tables import READS_SQL, reads, table

#: Facts of runs, made of line items: a capture of a system over a trace.
FACTS_SQL = """
facts AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'unit-region' WHEN 'N' THEN 'unit-file' ELSE 'append-only' END AS system, l_linestatus AS family, l_orderkey % 50 AS trace, l_orderkey * 10 + l_linenumber AS capture,
         l_discount AS exact_rate, CASE WHEN l_linenumber % 5 = 0 THEN 0.5 ELSE 1.0 END AS recall, CAST(l_suppkey % 4 = 0 AS BIGINT) AS stale_units, CAST(l_partkey % 6 = 0 AS BIGINT) AS duplicate_units,
         CAST(l_quantity AS BIGINT) AS bytes, l_extendedprice / 1000 AS latency
  FROM lineitem)"""


def _facts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "A", "unit-region").when(F.col("l_returnflag") == "N", "unit-file").otherwise("append-only").alias("system"), F.col("l_linestatus").alias("family"),
        (F.col("l_orderkey") % 50).alias("trace"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("capture"), F.col("l_discount").alias("exact_rate"),
        F.when(F.col("l_linenumber") % 5 == 0, 0.5).otherwise(1.0).alias("recall"), (F.col("l_suppkey") % 4 == 0).cast("bigint").alias("stale_units"), (F.col("l_partkey") % 6 == 0).cast("bigint").alias("duplicate_units"),
        F.col("l_quantity").cast("bigint").alias("bytes"), (F.col("l_extendedprice") / 1000).alias("latency"),
    )


def _required(spark, sf_dir):
    """Of each document (payload, capture) a benchmark item is required: that of its number, counted round the items."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("gold"))
    # One number of the table, beside which the items are dealt to the documents.
    items = (b.agg(F.max("item_id")).first()[0] or 0) + 1
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("capture"), (F.col("doc_id") % items).alias("item_id"))
    return d.join(b, "item_id").select("capture", F.col("item_id").alias("place"), F.col("item_id").cast("string").alias("key"), F.concat(F.lit("b"), (F.col("item_id") % 3).cast("string")).alias("path"), "gold")


def _payloads(spark, sf_dir):
    """Each document's text, with its required item twice, once or not at its end."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("capture"), F.coalesce("text", F.lit("")).alias("t"))
    n = (F.col("capture") % 3).cast("int")
    return d.join(_required(spark, sf_dir).select("capture", "gold"), "capture").select("capture", F.concat(F.col("t"), F.repeat(F.concat(F.lit("\n\n"), F.col("gold")), n)).alias("payload"))


_REQUIRED_SQL = """
req AS (SELECT d.doc_id AS capture, 'b' || (item_id % 3) AS path, coalesce(b.text, '') AS gold, coalesce(d.text, '') AS t FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))"""
_PAYLOADS_SQL = f"""{_REQUIRED_SQL},
pay AS (SELECT capture, path, gold, t || repeat(chr(10) || chr(10) || gold, CAST(capture % 3 AS INT)) AS payload FROM req),
cnt AS (SELECT *, CAST((length(payload) - length(replace(payload, gold, ''))) // length(gold) AS BIGINT) AS n FROM pay)"""


def required_recall(spark, sf_dir):
    projected = _required(spark, sf_dir).filter("capture % 2 = 0").select("capture", "path", F.sha2("gold", 256).alias("sha256"))
    return metrics.recall(metrics.required_hits(_required(spark, sf_dir), _payloads(spark, sf_dir), projected))


def exact_current_rate(spark, sf_dir):
    r = _required(spark, sf_dir)
    projected = r.select("capture", "path", F.sha2(F.when(F.col("capture") % 2 == 0, F.col("gold")).otherwise(F.lit("old")), 256).alias("sha256"))
    return metrics.exact_rate(projected, r)


def stale_bytes(spark, sf_dir):
    old = _required(spark, sf_dir).select("capture", F.col("gold").alias("initial"), F.when(F.col("capture") % 5 == 0, F.col("gold")).otherwise(F.lit("new")).alias("gold"))
    return metrics.stale(old, _payloads(spark, sf_dir))


def duplicate_units(spark, sf_dir):
    return metrics.duplicates(_required(spark, sf_dir), _payloads(spark, sf_dir))


def byte_sizes(spark, sf_dir):
    p = _payloads(spark, sf_dir).withColumn("projection", F.when(F.col("capture") % 2 == 0, F.lit("abc é")))
    return metrics.sizes(p).select("capture", "payload_bytes", "projection_bytes")


def gold_in_payload(spark, sf_dir):
    b = _required(spark, sf_dir)
    rows = _payloads(spark, sf_dir).join(b.select("capture", "gold"), "capture")
    quoted = F.when(F.col("capture") % 2 == 0, text.json_escaped(F.col("payload"))).otherwise(F.col("payload"))
    return rows.select("capture", metrics.gold_in_payload(quoted, F.col("gold")).alias("found"))


def passage_occurrences(spark, sf_dir):
    """How often each document's text, with its required item at its end, holds that item."""
    rows = _payloads(spark, sf_dir).join(_required(spark, sf_dir).select("capture", "gold"), "capture")
    return rows.select("capture", text.occurrences(F.col("payload"), F.col("gold")).alias("n"))


def prefix_reuse(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    p = c.select("conv_id", "turn", F.concat(F.lit("system prompt\n"), F.col("text")).alias("payload"))
    return metrics.prefix_reuse(p, ["conv_id"], "turn").select("conv_id", "turn", F.round("reuse", 9).alias("reuse"))


def changed_bytes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<<"), "text", F.lit(">>")).alias("t"))
    rows = c.withColumn("before", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")
    return rows.select("conv_id", "turn", metrics.changed_bytes(F.col("before"), F.col("t")).cast("bigint").alias("changed"))


def latency_percentiles(spark, sf_dir):
    return metrics.distribution(_facts(spark, sf_dir), ["system", "family"], "latency")


def metric_report(spark, sf_dir):
    out = metrics.report(_facts(spark, sf_dir), ["system", "family"], ["exact_rate", "recall"], ["bytes"], "latency")
    return out.withColumns({c: F.round(c, 9) for c in ("exact_rate", "recall")})


def final_capture(spark, sf_dir):
    return metrics.final_captures(_facts(spark, sf_dir).select("trace", "system", "capture", "bytes", "recall"), ["trace", "system"], "capture")


def hard_gates(spark, sf_dir):
    return metrics.gate_failures(_facts(spark, sf_dir), "unit-")


def best_snapshot(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("place", F.col("capture"))
    return metrics.best_snapshot(f, ["trace", "system"])


def capture_judge(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("capture", F.when(F.col("capture") % 7 != 0, F.col("capture")))
    return metrics.judged(f).groupBy("system", "reason").agg(F.count("*").alias("n"))


def cell_judge(spark, sf_dir):
    k = F.col("k")
    c = reads(spark, sf_dir).select("event_id", F.when(k % 5 == 0, "file").otherwise("symbol").alias("scope"), F.when(k % 7 == 0, "missing").when(k % 7 == 1, "error").otherwise("ok").alias("spawn"), (k % 11 == 0).alias("fail_open"), (k % 3 == 0).alias("gold_in_payload"))
    return metrics.judged_cells(c).select("event_id", "reason")


def redundant_reads(spark, sf_dir):
    r = reads(spark, sf_dir)
    e = r.select(F.col("session").alias("trace"), F.when(F.col("k") % 10 == 0, "capture-request").otherwise("read").alias("type"), "path", "scope", "selector")
    return metrics.redundant_reads(e)


def empirical_verdict(spark, sf_dir):
    f = _facts(spark, sf_dir)
    by = f.groupBy("trace").agg(
        F.sum(F.when(F.col("system") == "unit-region", F.col("bytes"))).alias("candidate_bytes"), F.sum(F.when(F.col("system") != "unit-region", F.col("bytes"))).alias("baseline_bytes"),
        F.count("*").alias("required"), F.count_if(F.col("recall") == 1).alias("hits"), F.lit(0).cast("bigint").alias("stale_units"), F.lit(0).cast("bigint").alias("duplicate_units"),
    )
    return metrics.verdict(by).drop("gate_captured")


def pack_evaluation(spark, sf_dir):
    f = _facts(spark, sf_dir).select("system", F.col("family").alias("repo"), F.col("trace").cast("string").alias("selector"), "bytes")
    return metrics.pack_evaluation(f, "unit-region", "append-only")


def arm_deltas(spark, sf_dir):
    f = _facts(spark, sf_dir).groupBy("trace", "system").agg(F.sum("bytes").alias("bytes"))
    return metrics.arm_deltas(f, ["trace"], "system", "append-only", ["bytes"])


def tier_deltas(spark, sf_dir):
    f = _facts(spark, sf_dir).groupBy("trace", "system").agg(F.sum("bytes").alias("bytes"))
    return metrics.tier_deltas(f, ["trace"], "system", "bytes")


def determinism(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("digest"))
    return metrics.determinism(d, ["source"], "digest").withColumn("agreement", F.round("agreement", 9))


def determinism_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("ms"))
    other = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus")))
    return metrics.run_differences(o, other, ["ms"])


def recorded_values(spark, sf_dir):
    e = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    a = table(spark, sf_dir, "nation").filter("n_nationkey % 5 > 0").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "9").otherwise(F.col("n_regionkey").cast("string")).alias("value"))
    return metrics.mismatches(e, a)


def pareto_front(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 17).alias("cost"), F.col("s_acctbal").alias("gain"))
    return metrics.pareto(s, "cost", "gain").select("s_suppkey", "cost", "gain")


def bootstrap_deltas(spark, sf_dir):
    f = _facts(spark, sf_dir).select("system", F.col("capture").alias("id"), "latency")
    return metrics.bootstrap_means(f, ["system"], "latency").select("system", "mean", "low", "high")


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", estimated_tokens(F.octet_length("text")).cast("bigint").alias("tokens"))


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.octet_length("text").cast("bigint")
    return c.select(
        F.concat(F.lit("arm"), (F.col("conv_id") % 4).cast("string")).alias("arm"), (F.col("conv_id") * 100 + F.col("turn") + 1).alias("turn"), F.lit(None).cast("string").alias("cell_id"), n.alias("request_bytes"),
        F.when((F.col("conv_id") % 4 == 1) | (F.col("conv_id") % 8 == 2), n * 2).alias("prompt_tokens"), F.when(F.col("turn") % 2 == 0, n).alias("completion_tokens"), F.lit(None).cast("string").alias("source"),
    )


def cost_proxy(spark, sf_dir):
    out = ledger.decorated(_turns(spark, sf_dir))
    return out.select("arm", "turn", "cell_id", "source", "token_source", F.col("estimated_prompt_tokens").cast("bigint").alias("estimated"), F.round("cost", 12).alias("cost"), F.round("cost_estimated", 12).alias("cost_estimated"))


def ledger_cumulative(spark, sf_dir):
    out = ledger.cumulative(ledger.decorated(_turns(spark, sf_dir)))
    return out.select("arm", "turn", "cumulative_request_bytes", "cumulative_prompt_tokens", F.round("cumulative_cost", 9).alias("cumulative_cost"))


def ledger_totals(spark, sf_dir):
    out = ledger.totals(ledger.decorated(_turns(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("cost", "cost_estimated")}).withColumn("estimated_prompt_tokens", F.col("estimated_prompt_tokens").cast("bigint"))


def ledger_arm_deltas(spark, sf_dir):
    out = ledger.arm_comparison(ledger.totals(ledger.decorated(_turns(spark, sf_dir))), "arm1")
    return out.select("arm", "request_bytes_delta", "prompt_tokens_delta", F.round("cost_delta", 9).alias("cost_delta"), F.round("cost_estimated_delta", 9).alias("cost_estimated_delta"))


def ledger_turn_errors(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("turn", F.when(F.col("turn") % 50 == 0, F.lit(0)).otherwise(F.col("turn") % 1000))
    return ledger.turn_errors(t)


def session_kind(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").alias("session"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("cell_id"), F.when(F.col("conv_id") % 10 == 3, "four-turn pack").alias("label"))
    return ledger.session_kinds(t)


def success_board(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    cells = lab.select((F.col("doc_id") % 60).alias("task"), F.when(F.col("quality") == 1, "yes").when(F.col("doc_id") % 3 == 0, "n/a").otherwise("no").alias("exact"), F.when(F.col("toxic") == 0, "yes").when(F.col("doc_id") % 3 == 0, "n/a").otherwise("no").alias("stdout"), (F.col("doc_id") % 41 == 0).alias("missing"))
    return ledger.board(cells, ["task"])


def payload_scan(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("payload"))
    return ledger.payload_scan(p, {"has_nav": "<nav>", "has_ad": 'class="ad"'}).select("page_id", "bytes", "has_nav", "has_ad", "resolution")


def usage_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"usage": {"prompt_tokens": '), k, F.lit(', "output_tokens": 7}}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('x "usage": {"completion_tokens": '), k, F.lit("}"))).otherwise(F.col("props"))
    u = ledger.usage(body)
    return table(spark, sf_dir, "events").select("event_id", u.alias("u")).select("event_id", "u.prompt_tokens", "u.completion_tokens", "u.usage_from")


def stream_usage(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('data: {"usage": {"a": 1}}\n\ndata: {"usage": {"a": '), k, F.lit("}}\ndata: [DONE]\n"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(ledger.stream_usage(body), "$.a").cast("bigint").alias("a"))


def scan_ingest(spark, sf_dir):
    r = reads(spark, sf_dir)
    scans = r.select(F.concat(F.lit("s"), F.col("session").cast("string")).alias("arm"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("file"), F.when(F.col("k") % 2 == 0, F.col("seq") + 1000).alias("n"), F.col("k").alias("bytes"), F.array(F.col("k"), F.when(F.col("k") % 3 == 0, F.col("k") + 1)).alias("prompt_tokens"))
    return ledger.scan_turns(scans)


def answer_scoring(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('so:\n```json\n{"answer": '), k, F.lit("}\n```"))).otherwise(F.concat(F.lit('{"answer": '), k, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", ledger.answer_matches(answer, F.col("event_id") % 100).alias("right"))


def spend_rollup(spark, sf_dir):
    u = reads(spark, sf_dir).select(F.col("kind").alias("arm"), F.col("k").alias("prompt_tokens"), F.col("seq").alias("completion_tokens"))
    return ledger.spend(u, 0.22, 0.66).withColumn("usd", F.round("usd", 12))


def redaction(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"a": {"api_key": "s'), k, F.lit('", "n": '), k, F.lit('}, "Authorization": ["Bearer '), k, F.lit('", {"x": [1]}], "list": [{"token": {"v": "'), k, F.lit('"}, "m": '), k, F.lit("}], \"note\": \"a \\\"token\\\": b\"}")
    )
    return table(spark, sf_dir, "events").select("event_id", ledger.redacted(body).alias("body"))


def attestation_errors(spark, sf_dir):
    i = F.col("o_orderkey")
    fields = {
        "schemaVersion": F.lit("1"), "packId": F.lit("p"), "freezeCommitSha": F.when(i % 5 == 0, F.lit("abc")).otherwise(F.sha1(i.cast("string").cast("binary"))), "manifestSha256": F.sha2(i.cast("string"), 256), "reposLockSha256": F.lit("x"),
        "repositoryLocks": F.lit("y"), "workflowRunId": F.when(i % 7 == 0, F.lit("local-run")).otherwise(i.cast("string")), "workflowRunUrl": F.concat(F.lit("https://github.com/o/r/actions/runs/"), i.cast("string")), "attestedAt": F.when(i % 11 > 0, F.lit("2024")),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", provenance.attestation_error(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))).alias("error"))


def classification_steps(spark, sf_dir):
    names = F.array(*map(F.lit, provenance.CLASSIFICATIONS))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("a"), F.get(names, (F.col("o_custkey") % 5).cast("int")).alias("b"))
    return o.select("o_orderkey", provenance.advancement_error(F.col("a"), F.col("b")).alias("error"))


def earned_classification(spark, sf_dir):
    names = F.array(*map(F.lit, provenance.CLASSIFICATIONS))
    i = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (i % 5).cast("int")).alias("claimed"), (i % 2 == 0).alias("attested"), (i % 3 > 0).alias("report"), (i % 7 > 0).alias("run"), F.lit(True).alias("generated"), (i % 4 == 0).alias("frozen"))
    return provenance.earned(o).select("o_orderkey", "earned")


def verify_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("pack"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), "doc_id")
    actual = d.filter("doc_id % 50 > 0").withColumn("sha256", F.when(F.col("doc_id") % 70 == 1, "0").otherwise(F.col("sha256")))
    out = provenance.verified(d, actual, ["pack"])
    return out.select("pack", "checked", F.array_join("errors", ";").alias("errors"))


def pack_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("pack"), F.when(F.col("doc_id") % 4 == 0, "trace").when(F.col("doc_id") % 4 == 1, "result").when(F.col("doc_id") % 9 == 0, "manifest").otherwise("other").alias("kind"), (F.col("doc_id") % 200 == 3).alias("exempt"))
    return provenance.guard(d).select("pack", F.array_join("errors", ",").alias("errors"))


def corpus_lock(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("ref"), F.col("p_type").alias("sha256"))
    lock = p.filter("id % 10 > 0").select("id", F.when(F.col("id") % 10 == 1, "z").otherwise(F.col("ref")).alias("ref"), F.when(F.col("id") % 10 == 2, "z").otherwise(F.col("sha256")).alias("sha256"))
    return provenance.lock_errors(p, lock)


def phase_order(spark, sf_dir):
    names = F.array(*map(F.lit, ("manifest", "freeze", "generate", "run", "report")))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pack"), F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("phase"), F.col("o_orderkey").alias("seq"))
    return provenance.phase_errors(o.groupBy("pack", "phase").agg(F.min("seq").alias("seq")))


def required_oracle(spark, sf_dir):
    """Current text of region reads after an edit, by the reads' own rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    edited = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new line\n"), F.col("t"))).when(F.col("doc_id") % 3 == 1, F.col("t"))
    initial = text.line_slice(F.col("t"), F.lit(1), F.lit(2))
    g = replay.gold(edited, F.when(F.col("doc_id") % 5 == 0, "file").otherwise("region"), F.lit(1), F.lit(2), initial)
    return d.select("doc_id", F.sha2(g, 256).alias("gold_sha256"))


def replace_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.sha2(replay.replaced_first(F.col("t"), F.lit("th"), F.lit("[$1]")), 256).alias("text_sha256"))


def baseline_payloads(spark, sf_dir):
    r = reads(spark, sf_dir)
    rd = r.select(F.col("session").alias("trace"), "seq", "path", "content")
    captures = rd.select("trace").distinct().withColumn("task", F.lit("go"))
    files = rd.groupBy("trace", "path").agg(F.max_by("content", "seq").alias("content")).filter("path != 'src/f3.py'")
    return replay.baseline_payloads(rd, captures, files).select("trace", "system", F.sha2("payload", 256).alias("payload_sha256"))


def markdown_cells(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    doc = F.concat(F.lit("# Title\n\n| name | key |\n|---|---|\n| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |\n"))
    return readers.table_cells(n.select("n_nationkey", doc.alias("value")), "n_nationkey").select("n_nationkey", "row", "column", "value")


def recorded_verdict(spark, sf_dir):
    log = F.concat(F.lit("noise\nEVALUATE_VERDICT={\"v\": "), F.col("event_id").cast("string"), F.lit("}\nend"))
    v = F.get_json_object(readers.recorded_verdict(log), "$.v").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", v.alias("v"))


def target_discovery(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 9 == 0, "apex-").otherwise("dev-"), F.col("source")).alias("pack")).distinct()
    return readers.target(p)


def source_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.filter("doc_id % 4 > 0").select(F.concat(F.lit("./s/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return readers.looked_up(d.select("doc_id", F.concat(F.lit("s/"), F.col("doc_id").cast("string")).alias("path")), files).select("doc_id", F.sha2("content", 256).alias("sha256"))


def unsafe_paths(spark, sf_dir):
    p = F.concat(F.when(F.col("doc_id") % 4 == 0, "../").when(F.col("doc_id") % 4 == 1, "/").when(F.col("doc_id") % 4 == 2, "C:\\").otherwise(""), F.lit("a"))
    return table(spark, sf_dir, "documents").select("doc_id", readers.unsafe_path(p).alias("unsafe"))


def stale_rate_normal(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return f.select("capture", "trace", metrics.normal_stale_rate(F.col("stale_units"), F.col("bytes")).alias("rate"), metrics.budget_overflow(F.col("bytes"), F.lit(30)).alias("overflow"))


def recovery_success(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").cast("string").alias("unit_id"), F.sha2("text", 256).alias("revision"))
    return metrics.recovery_ratio(d, d.filter("cast(unit_id as bigint) % 4 > 0")).withColumn("ratio", F.round("ratio", 9))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

_TURNS_SQL = """turns AS (SELECT 'arm' || (conv_id % 4) AS arm, conv_id * 100 + turn + 1 AS turn, strlen(text) AS rb, CASE WHEN conv_id % 4 = 1 OR conv_id % 8 = 2 THEN strlen(text) * 2 END AS pt, CASE WHEN turn % 2 = 0 THEN strlen(text) END AS ct FROM conversations),
dec AS (SELECT *, coalesce(pt, CAST(ceil(rb / 4) AS BIGINT)) AS est, pt / 1e6 * 0.22 + coalesce(ct, 0) / 1e6 * 0.66 AS cost, coalesce(pt, CAST(ceil(rb / 4) AS BIGINT)) / 1e6 * 0.22 + coalesce(ct, 0) / 1e6 * 0.66 AS ce FROM turns),
tot AS (SELECT arm, count(*) AS turns, CAST(sum(rb) AS BIGINT) AS request_bytes, CAST(sum(pt) AS BIGINT) AS p, CAST(sum(ct) AS BIGINT) AS c, CAST(sum(est) AS BIGINT) AS estimated_prompt_tokens, CASE WHEN count(pt) = count(*) THEN 'provider' WHEN count(pt) = 0 THEN 'bytes-estimate' ELSE 'mixed' END AS token_source FROM dec GROUP BY arm),
led AS (SELECT arm, turns, request_bytes, CASE WHEN token_source <> 'bytes-estimate' THEN p END AS prompt_tokens, CASE WHEN token_source <> 'bytes-estimate' THEN c END AS completion_tokens, estimated_prompt_tokens,
  CASE WHEN token_source = 'provider' THEN p / 1e6 * 0.22 + coalesce(c, 0) / 1e6 * 0.66 END AS cost, estimated_prompt_tokens / 1e6 * 0.22 + CASE WHEN token_source <> 'bytes-estimate' THEN coalesce(c, 0) ELSE coalesce(c, 0) END / 1e6 * 0.66 AS cost_estimated, token_source FROM tot)"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

ORACLE_SQL = {
    "required_recall": f"WITH {_PAYLOADS_SQL} SELECT capture, CAST(1 AS BIGINT) AS required, CAST(CASE WHEN capture % 2 = 0 OR n > 0 THEN 1 ELSE 0 END AS BIGINT) AS hits, CASE WHEN capture % 2 = 0 OR n > 0 THEN 1.0 ELSE 0.0 END AS recall FROM cnt",
    "exact_current_rate": f"WITH {_REQUIRED_SQL} SELECT capture, CAST(capture % 2 = 0 AS BIGINT) AS exact, CAST(1 AS BIGINT) AS projected, CASE WHEN capture % 2 = 0 THEN 1.0 ELSE 0.0 END AS exact_rate FROM req",
    "stale_bytes": f"WITH {_PAYLOADS_SQL}, s AS (SELECT capture, gold, CASE WHEN capture % 5 = 0 THEN 0 ELSE n END AS n FROM cnt) SELECT capture, CAST(1 AS BIGINT) AS reads, CAST(n > 0 AS BIGINT) AS stale_units, CAST(n * strlen(gold) AS BIGINT) AS stale_bytes, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS stale_rate FROM s",
    "duplicate_units": f"WITH {_PAYLOADS_SQL} SELECT capture, greatest(n - 1, 0) AS duplicate_units, CAST(greatest(n - 1, 0) * strlen(gold) AS BIGINT) AS duplicate_bytes FROM cnt",
    "byte_sizes": f"WITH {_PAYLOADS_SQL} SELECT capture, CAST(strlen(payload) AS BIGINT) AS payload_bytes, CAST(CASE WHEN capture % 2 = 0 THEN 6 ELSE strlen(payload) END AS BIGINT) AS projection_bytes FROM cnt",
    "gold_in_payload": f"WITH {_PAYLOADS_SQL} SELECT capture, n > 0 AS found FROM cnt",
    "passage_occurrences": f"WITH {_PAYLOADS_SQL} SELECT capture, n FROM cnt",
    "prefix_reuse": """WITH p AS (SELECT conv_id, turn, CAST(encode('system prompt' || chr(10) || text) AS BLOB) AS b FROM conversations),
q AS (SELECT conv_id, turn, hex(b) AS h, lag(hex(b)) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p)
SELECT conv_id, turn, CASE WHEN g IS NULL THEN 1.0 ELSE round(coalesce(list_position(list_transform(range(CAST(least(length(g), length(h)) // 2 AS BIGINT)), lambda i: substr(g, 2 * i + 1, 2) <> substr(h, 2 * i + 1, 2)), true) - 1, least(length(g), length(h)) // 2) / (length(g) / 2), 9) END AS reuse FROM q""",
    "changed_bytes": """WITH q AS (SELECT conv_id, turn, hex(encode('<<' || text || '>>')) AS h, lag(hex(encode('<<' || text || '>>'))) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
s AS (SELECT *, coalesce(list_position(list_transform(range(CAST(least(length(g), length(h)) // 2 AS BIGINT)), lambda i: substr(g, 2 * i + 1, 2) <> substr(h, 2 * i + 1, 2)), true) - 1, least(length(g), length(h)) // 2) AS a FROM q WHERE g IS NOT NULL),
t AS (SELECT *, substr(g, 2 * a + 1) AS g2, substr(h, 2 * a + 1) AS h2 FROM s),
u AS (SELECT *, coalesce(list_position(list_transform(range(CAST(least(length(g2), length(h2)) // 2 AS BIGINT)), lambda i: substr(g2, length(g2) - 2 * i - 1, 2) <> substr(h2, length(h2) - 2 * i - 1, 2)), true) - 1, least(length(g2), length(h2)) // 2) AS z FROM t)
SELECT conv_id, turn, CAST(greatest(length(g2), length(h2)) // 2 - z AS BIGINT) AS changed FROM u""",
    "latency_percentiles": f"WITH {FACTS_SQL} SELECT system, family, count(*) AS n, min(latency) AS min, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99, max(latency) AS max FROM facts GROUP BY system, family",
    "metric_report": f"WITH {FACTS_SQL} SELECT system, family, count(*) AS captures, round(avg(exact_rate), 9) AS exact_rate, round(avg(recall), 9) AS recall, CAST(floor(avg(bytes) + 0.5) AS BIGINT) AS bytes, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM facts GROUP BY system, family",
    "final_capture": f"WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY trace, system ORDER BY capture DESC, bytes DESC, recall DESC) AS r FROM facts) SELECT trace, system, capture, bytes, recall FROM r WHERE r = 1",
    "hard_gates": f"WITH {FACTS_SQL} SELECT system, count(*) FILTER (stale_units > 0) AS stale, count(*) FILTER (duplicate_units > 0) AS duplicate, count(*) FILTER (recall < 1) AS recall FROM facts WHERE system LIKE 'unit-%' GROUP BY system",
    "best_snapshot": f"WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY trace, system ORDER BY exact_rate DESC, capture DESC) AS r FROM facts WHERE recall = 1) SELECT trace, system, capture, exact_rate FROM r WHERE r = 1",
    "capture_judge": f"WITH {FACTS_SQL} SELECT system, CASE WHEN capture % 7 = 0 THEN 'no-capture' WHEN stale_units > 0 THEN 'stale' WHEN duplicate_units > 0 THEN 'duplicate' WHEN recall < 1 THEN 'recall' ELSE 'pass' END AS reason, count(*) AS n FROM facts GROUP BY 1, 2",
    "cell_judge": f"WITH {READS_SQL} SELECT event_id, CASE WHEN k % 5 = 0 THEN 'observation-not-symbol' WHEN k % 7 = 0 THEN 'missing-engine' WHEN k % 7 = 1 THEN 'engine-error' WHEN k % 11 = 0 THEN 'fail-open' WHEN k % 3 <> 0 THEN 'gold-absent' ELSE 'pass' END AS reason FROM reads",
    "redundant_reads": f"""WITH {READS_SQL}, e AS (SELECT session AS trace, path, scope, count(*) AS n FROM reads WHERE k % 10 <> 0 GROUP BY ALL), s AS (SELECT trace, CAST(sum(n) AS BIGINT) AS reads, CAST(sum(n - 1) AS BIGINT) AS redundant FROM e GROUP BY trace), c AS (SELECT session AS trace, count(*) FILTER (k % 10 = 0) AS cycles FROM reads GROUP BY session)
SELECT trace, coalesce(reads, 0) AS reads, coalesce(redundant, 0) AS redundant, cycles FROM c LEFT JOIN s USING (trace)""",
    "empirical_verdict": f"""WITH {FACTS_SQL}, t AS (SELECT trace, sum(bytes) FILTER (system = 'unit-region') AS c, sum(bytes) FILTER (system <> 'unit-region') AS b, count(*) AS r, count(*) FILTER (recall = 1) AS h FROM facts GROUP BY trace),
s AS (SELECT count(*) AS traces, CAST(sum(c) AS BIGINT) AS candidate_bytes, CAST(sum(b) AS BIGINT) AS baseline_bytes, CAST(sum(r) AS BIGINT) AS required, CAST(sum(h) AS BIGINT) AS hits FROM t)
SELECT *, CAST(0 AS BIGINT) AS stale_units, CAST(0 AS BIGINT) AS duplicate_units, candidate_bytes - baseline_bytes AS delta, hits = required AS gate_recall, true AS gate_stale, true AS gate_duplicate, CASE WHEN hits = required AND candidate_bytes < baseline_bytes THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s""",
    "pack_evaluation": f"""WITH {FACTS_SQL}, p AS (SELECT family AS repo, CAST(trace AS VARCHAR) AS selector, CAST(sum(bytes) FILTER (system = 'unit-region') AS BIGINT) AS candidate_bytes, CAST(sum(bytes) FILTER (system = 'append-only') AS BIGINT) AS baseline_bytes FROM facts GROUP BY 1, 2)
SELECT *, candidate_bytes - baseline_bytes AS delta FROM p WHERE candidate_bytes IS NOT NULL AND baseline_bytes IS NOT NULL""",
    "arm_deltas": f"WITH {FACTS_SQL}, s AS (SELECT trace, system, CAST(sum(bytes) AS BIGINT) AS bytes FROM facts GROUP BY trace, system) SELECT s.trace, s.system, s.bytes - c.bytes AS bytes_delta, c.bytes IS NULL AS missing FROM s LEFT JOIN s c ON c.trace = s.trace AND c.system = 'append-only' WHERE s.system <> 'append-only'",
    "tier_deltas": f"WITH {FACTS_SQL}, s AS (SELECT trace, system, CAST(sum(bytes) AS BIGINT) AS bytes FROM facts GROUP BY trace, system) SELECT *, bytes - lead(bytes) OVER w AS to_coarser, bytes - last_value(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS to_base FROM s WINDOW w AS (PARTITION BY trace ORDER BY system)",
    "determinism": "WITH e AS (SELECT source, md5(text) AS d, count(*) AS n FROM documents GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS runs, count(*) AS distinct, round(max(n) / sum(n), 9) AS agreement, count(*) = 1 AS deterministic FROM e GROUP BY source",
    "determinism_check": "SELECT o_orderkey, o_orderstatus, 'first' AS only_in FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, 'X', 'second' FROM orders WHERE o_orderkey % 100 = 0",
    "recorded_values": "WITH a AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '9' ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation WHERE n_nationkey % 5 > 0) SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS expected, v AS actual FROM nation LEFT JOIN a ON a.name = n_name WHERE CAST(n_regionkey AS VARCHAR) IS DISTINCT FROM v",
    "pareto_front": "WITH s AS (SELECT s_suppkey, s_suppkey % 17 AS cost, s_acctbal AS gain FROM supplier) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.cost <= a.cost AND b.gain >= a.gain AND (b.cost < a.cost OR b.gain > a.gain))",
    "token_estimate": "SELECT doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens FROM documents",
    "cost_proxy": f"WITH {_TURNS_SQL} SELECT arm, turn, 't' || turn AS cell_id, CASE WHEN pt IS NULL THEN 'synthetic' ELSE 'provider' END AS source, CASE WHEN pt IS NULL THEN 'bytes-estimate' ELSE 'provider' END AS token_source, est AS estimated, round(cost, 12) AS cost, round(ce, 12) AS cost_estimated FROM dec",
    "ledger_cumulative": f"WITH {_TURNS_SQL} SELECT arm, turn, CAST(sum(rb) OVER w AS BIGINT) AS cumulative_request_bytes, CAST(sum(pt) OVER w AS BIGINT) AS cumulative_prompt_tokens, round(sum(cost) OVER w, 9) AS cumulative_cost FROM dec WINDOW w AS (PARTITION BY arm ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    "ledger_totals": f"WITH {_TURNS_SQL} SELECT arm, turns, request_bytes, prompt_tokens, completion_tokens, estimated_prompt_tokens, round(cost, 9) AS cost, round(cost_estimated, 9) AS cost_estimated, token_source FROM led",
    "ledger_arm_deltas": f"WITH {_TURNS_SQL}, b AS (SELECT * FROM led WHERE arm = 'arm1') SELECT l.arm, l.request_bytes - b.request_bytes AS request_bytes_delta, l.prompt_tokens - b.prompt_tokens AS prompt_tokens_delta, round(l.cost - b.cost, 9) AS cost_delta, round(l.cost_estimated - b.cost_estimated, 9) AS cost_estimated_delta FROM led l, b",
    "ledger_turn_errors": f"WITH {_TURNS_SQL}, t AS (SELECT arm, CASE WHEN turn % 50 = 0 THEN 0 ELSE turn % 1000 END AS turn FROM turns), n AS (SELECT arm, turn, count(*) AS n FROM t GROUP BY arm, turn) SELECT arm, turn, CASE WHEN turn < 1 THEN 'turn must be a positive integer' ELSE 'duplicate turn' END AS error FROM n WHERE turn < 1 OR n > 1",
    "session_kind": """WITH s AS (SELECT conv_id AS session, count(*) AS turns, conv_id % 2 = 0 AS named, conv_id % 10 = 3 AS four FROM conversations GROUP BY conv_id),
k AS (SELECT *, CASE WHEN turns = 2 AND NOT named THEN 'two-turn' WHEN four THEN 'four-turn' WHEN turns < 8 THEN 'short' ELSE 'long' END AS kind FROM s) SELECT session, turns, kind, kind = 'long' AS valid FROM k""",
    "success_board": """WITH c AS (SELECT doc_id % 60 AS task, CASE WHEN quality = 1 THEN 'yes' WHEN doc_id % 3 = 0 THEN 'n/a' ELSE 'no' END AS e, CASE WHEN toxic = 0 THEN 'yes' WHEN doc_id % 3 = 0 THEN 'n/a' ELSE 'no' END AS s, doc_id % 41 = 0 AS m FROM labels),
v AS (SELECT task, CASE WHEN m THEN 'missing' WHEN e = 'n/a' AND s = 'n/a' THEN 'n/a' WHEN e = 'yes' AND s = 'yes' THEN 'pass' ELSE 'fail' END AS v FROM c),
g AS (SELECT task, count(*) FILTER (v IN ('missing', 'fail')) AS f, count(*) FILTER (v = 'missing') AS m, count(*) FILTER (v = 'pass') AS p FROM v GROUP BY task)
SELECT task, CASE WHEN f = 0 AND p > 0 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN f = 0 AND p > 0 THEN 'exact-current-and-stdout' WHEN m > 0 OR f = 0 THEN 'missing-dump' ELSE 'assert-failed' END AS reason FROM g""",
    "payload_scan": """SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, contains(html, '<nav>') AS has_nav, contains(html, 'class="ad"') AS has_ad, 'none' AS resolution FROM pages""",
    "usage_extract": f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_K} END AS prompt_tokens, CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN {_K} END AS completion_tokens, CASE WHEN event_id % 3 < 2 THEN 'provider-response' ELSE 'none' END AS usage_from FROM events",
    "stream_usage": f"SELECT event_id, {_K} AS a FROM events",
    "scan_ingest": f"WITH {READS_SQL} SELECT 's' || session AS arm, CASE WHEN k % 2 = 0 THEN seq + 1000 ELSE row_number() OVER (PARTITION BY session ORDER BY event_id) END AS turn, k AS request_bytes, CASE WHEN k % 3 = 0 THEN k + 1 ELSE k END AS last_prompt_tokens, CASE WHEN k % 3 = 0 THEN 2 * k + 1 ELSE k END AS prompt_tokens FROM reads",
    "answer_scoring": f"SELECT event_id, {_K} = event_id % 100 AS right FROM events",
    "spend_rollup": f"WITH {READS_SQL} SELECT kind AS arm, count(*) AS requests, CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(seq) AS BIGINT) AS completion_tokens, round(sum(k) / 1e6 * 0.22 + sum(seq) / 1e6 * 0.66, 12) AS usd FROM reads GROUP BY ROLLUP (kind)",
    "redaction": f"""SELECT event_id, '{{"a": {{"api_key": "[redacted]", "n": ' || {_K} || '}}, "Authorization": "[redacted]", "list": [{{"token": "[redacted]", "m": ' || {_K} || '}}], "note": "a \\"token\\": b"}}' AS body FROM events""",
    "attestation_errors": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing attestedAt' WHEN o_orderkey % 5 = 0 THEN 'freezeCommitSha invalid' WHEN o_orderkey % 7 = 0 THEN 'no production run id' END AS error FROM orders",
    "classification_steps": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = o_custkey % 5 THEN NULL WHEN o_custkey % 5 <= o_orderkey % 5 AND o_orderkey % 5 <> 1 THEN 'regress' WHEN o_custkey % 5 - o_orderkey % 5 > 1 AND o_custkey % 5 <> 1 THEN 'skip' END AS error FROM orders""",
    "earned_classification": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 7 > 0 THEN 'sealed' END WHEN 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'remotely-attested' END WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'locally-frozen' END WHEN 1 THEN 'candidate' END AS earned FROM orders",
    "verify_pack": "SELECT source AS pack, count(*) AS checked, coalesce(string_agg(CASE WHEN doc_id % 50 = 0 THEN 'missing ' || doc_id WHEN doc_id % 70 = 1 THEN 'hash mismatch ' || doc_id END, ';' ORDER BY CASE WHEN doc_id % 50 = 0 THEN 'missing ' || doc_id WHEN doc_id % 70 = 1 THEN 'hash mismatch ' || doc_id END), '') AS errors FROM documents GROUP BY source",
    "pack_guard": """WITH d AS (SELECT doc_id % 97 AS pack, bool_or(doc_id % 4 = 0) AS t, bool_or(doc_id % 4 = 1) AS r, bool_or(doc_id % 200 = 3) AS x, bool_or(doc_id % 4 > 1 AND doc_id % 9 = 0) AS m FROM documents GROUP BY 1)
SELECT pack, array_to_string(list_filter([CASE WHEN t AND r THEN 'mixed-introduction' END, CASE WHEN x THEN 'exempt-forbidden' END, CASE WHEN t AND NOT m THEN 'stray-trace' END], lambda z: z IS NOT NULL), ',') AS errors FROM d""",
    "corpus_lock": "SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'not locked' WHEN 1 THEN 'ref differs' ELSE 'hash differs' END AS error FROM part WHERE p_partkey % 10 < 3",
    "phase_order": """WITH o AS (SELECT o_custkey AS pack, CAST(o_orderkey % 5 AS INT) AS p, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2), n AS (SELECT a.pack, a.p, b.i AS need FROM o a, (SELECT unnest([0, 1, 2, 3]) AS i) b LEFT JOIN o c ON c.pack = a.pack AND c.p = b.i WHERE b.i < a.p AND (c.seq IS NULL OR c.seq > a.seq))
SELECT pack, ['manifest', 'freeze', 'generate', 'run', 'report'][p + 1] AS phase, 'needs ' || string_agg(['manifest', 'freeze', 'generate', 'run'][need + 1], ',' ORDER BY ['manifest', 'freeze', 'generate', 'run'][need + 1]) AS error FROM n GROUP BY pack, p""",
    "required_oracle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'new line' || chr(10) || t WHEN 1 THEN t END AS now FROM d), f AS (SELECT *, string_split(now, chr(10)) AS n FROM e),
g AS (SELECT *, list_filter(range(1, len(n) + 1), lambda i: n[i] = l[1]) AS p FROM f WHERE now IS NOT NULL)
SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN now WHEN n[1] = l[1] OR len(p) <> 1 THEN array_to_string(n[1:2], chr(10)) ELSE array_to_string(n[p[1]:p[1] + 1], chr(10)) END) AS gold_sha256 FROM g UNION ALL SELECT doc_id, sha256('') FROM e WHERE now IS NULL""",
    "replace_exact": "SELECT doc_id, CASE WHEN instr(text, 'th') > 0 THEN sha256(substr(text, 1, instr(text, 'th') - 1) || '[$1]' || substr(text, instr(text, 'th') + 2)) END AS text_sha256 FROM documents",
    "baseline_payloads": f"""WITH {READS_SQL}, r AS (SELECT session AS trace, seq, path, content FROM reads), n AS (SELECT trace, path, arg_max(content, seq) AS content FROM r WHERE path <> 'src/f3.py' GROUP BY trace, path),
m AS (SELECT trace, string_agg('[whole-file path="' || path || '"]' || chr(10) || content, chr(10) || chr(10) ORDER BY path) AS now FROM n GROUP BY trace),
a AS (SELECT trace, string_agg(content, chr(10) || chr(10) ORDER BY seq) AS raw, string_agg('[observation-mask:' || path || '] An earlier read stood here; this system shows no text instead.', chr(10) || chr(10) ORDER BY seq) AS mask, string_agg('sync: ' || path, chr(10) || chr(10) ORDER BY seq) AS sync FROM r GROUP BY trace)
SELECT trace, 'append-only' AS system, sha256(raw || chr(10) || chr(10) || 'TASK: go') AS payload_sha256 FROM a UNION ALL SELECT trace, 'observation-mask', sha256(mask || chr(10) || chr(10) || 'TASK: go') FROM a
UNION ALL SELECT a.trace, 'whole-file', sha256(sync || chr(10) || chr(10) || 'TASK: go' || coalesce(chr(10) || chr(10) || now, '')) FROM a LEFT JOIN m ON m.trace = a.trace""",
    "markdown_cells": "SELECT n_nationkey, 0 AS row, 'name' AS column, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 0, 'key', CAST(n_nationkey AS VARCHAR) FROM nation",
    "recorded_verdict": "SELECT event_id, event_id AS v FROM events",
    "target_discovery": "SELECT coalesce(max('apex-' || source), 'smoke') AS pack FROM documents WHERE doc_id % 9 = 0",
    "source_lookup": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN sha256(text) END AS sha256 FROM documents",
    "unsafe_paths": "SELECT doc_id, doc_id % 4 < 3 AS unsafe FROM documents",
    "stale_rate_normal": f"WITH {FACTS_SQL} SELECT capture, trace, CAST(stale_units AS DOUBLE) / greatest(1, bytes) AS rate, greatest(bytes - 30, 0) AS overflow FROM facts",
    "recovery_success": "SELECT count(*) AS wanted, count(*) FILTER (doc_id % 4 > 0) AS recovered, round(count(*) FILTER (doc_id % 4 > 0) / count(*), 9) AS ratio FROM documents",
}
