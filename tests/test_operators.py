"""Operators on small tables with nulls, ties, repeats and empty inputs."""

import math

import pytest
from pyspark.sql import functions as F

from spanview import engine
from spanview.functions import ids, text
from spanview.operators import history, ledger, metrics, project, provenance, registry, select

READS = "session string, seq int, turn int, path string, scope string, selector string, start_line int, end_line int, content string, pinned boolean"


def reads(spark, *rows):
    return spark.createDataFrame([(s, i, i, p, "file", None, 1, None, c, False) for i, (s, p, c) in enumerate(rows)], READS)


def test_columns_agree_with_the_engine(spark):
    texts = ["", "a\nb", "é\U0001f600 x", "a\r\nb\n", "  Tab\there "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(text.utf16_length(F.col("t")), text.line_count(F.col("t")), F.array_sort(text.terms(F.col("t"))), ids.revision(F.col("t"))).collect()
    for t, r in zip(texts, got):
        assert (r[0], r[1], r[2], r[3]) == (engine.utf16_length(t), t.replace("\r\n", "\n").count("\n") + 1, sorted(engine.terms(t)), "sha256:" + engine.sha256(t))
    paths = ["a", "./a//b/../c", "/../x/", "a\\b", "../../q/..", "."]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(ids.normal_path(F.col("p"))).collect()] == [engine.normal_path(p) for p in paths]
    assert spark.range(1).select(ids.normal_path(F.lit(" "))).first()[0] is None


def test_prefixes_and_changes(spark):
    pairs = [("", ""), ("abc", "abd"), ("é1", "é2"), ("same", "same"), ("abcXdef", "abcYYdef"), ("aa", "aaa")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(text.common_prefix_bytes(F.col("a"), F.col("b")).alias("p"), metrics.changed_bytes(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.p for r in got] == [0, 2, 2, 4, 3, 2] and [r.c for r in got] == [0, 1, 1, 0, 2, 1]


def test_tracking_matches_the_engine(spark):
    rows = [("s", "f", "one"), ("s", "f", "two"), ("t", "f", "one"), ("s", "f", "two"), ("s", "g", "x\ny"), ("s", "f", "one")]
    got = {(r.session, r.path): r for r in registry.current_units(reads(spark, *rows)).collect()}
    sessions = {}
    for i, (s, p, c) in enumerate(rows):
        e = sessions.setdefault(s, engine.Session())
        e.turn = i
        e.read(p, c, scope="file")
    for s, e in sessions.items():
        for u in e.units.values():
            r = got[s, u.path]
            assert (r.unit_id, r.revision, r.change_count, r.changed_at, r.observed_at) == (u.id, u.revision, u.change_count, u.changed_at, u.observed_at)
    assert registry.versions(reads(spark, *rows)).count() == 4 and registry.current_units(reads(spark, *rows).limit(0)).count() == 0


def test_selection_matches_the_engine(spark):
    e = engine.Session()
    for i in range(40):
        e.turn = i % 7
        e.read(f"f{i}", "word thing " * (i % 9 + 1), pinned=i % 13 == 0)
    e.turn = 7
    for i in range(0, 40, 5):
        e.read(f"f{i}", "changed thing", end_line=1)
    e.units[sorted(e.units)[3]].state = "unresolved"
    rows = [("s", u.id, u.path, u.selector, u.content, u.last_used_at, u.changed_at, u.change_count, u.pinned, u.state, u.start_line, u.end_line, u.revision, u.method) for u in e.units.values()]
    df = spark.createDataFrame(rows, "session string, unit_id string, path string, selector string, content string, last_used_at int, changed_at int, change_count int, pinned boolean, state string, start_line int, end_line int, revision string, method string")
    for budget in (0, 300, 5000):
        chosen = select.selected(select.scored(df, "the thing", 7, budget), 7, budget)
        got = {r.unit_id: r.disposition for r in chosen.collect()}
        taken, omitted = e.select("the thing", budget)
        assert got == {**{u.id: "selected" for u in taken}, **{u.id: r for u, r in omitted}}
        order = [r.unit_id for r in select.render_order(chosen).orderBy("place").collect()]
        assert order == [u.id for u in sorted(taken, key=lambda u: (u.change_count, u.id))]
        text_ = project.projections(chosen, 7).first().text
        assert len(engine.decode(text_)) == len(taken)
    assert select.selected(select.scored(df.limit(0), "", 1), 1).count() == 0


def test_as_of_files(spark):
    events = spark.createDataFrame([("s", "f", 1, "a", False), ("s", "f", 3, "b", False), ("s", "g", 2, "c", False), ("s", "g", 5, None, True)], "session string, path string, seq int, content string, deleted boolean")
    captures = spark.createDataFrame([("s", 1, 0), ("s", 2, 2), ("s", 3, 9)], "session string, capture int, seq int")
    got = {(r.capture, r.path): r.content for r in registry.files_as_of(events, captures).collect()}
    assert got == {(2, "f"): "a", (2, "g"): "c", (3, "f"): "b", (3, "g"): None}


def test_pruning(spark):
    call = lambda *ids_: [{"id": i} for i in ids_]
    rows = [("s", 0, "user", "hi", [], None), ("s", 1, "assistant", "", call("a"), None), ("s", 2, "tool", "A", [], "a"), ("s", 3, "assistant", "why", call("b", "c"), None), ("s", 4, "tool", "B", [], "b"), ("s", 5, "tool", "C", [], "c"), ("t", 0, "user", None, None, None)]
    m = spark.createDataFrame(rows, "session string, seq int, role string, text string, tool_calls array<struct<id:string>>, call_id string")
    dropped = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "session string, call_id string")
    replaced = spark.createDataFrame([("s", "c", "[c]")], "session string, call_id string, marker string")
    got = [(r.session, r.seq, r.text, [c.id for c in r.tool_calls or []]) for r in history.pruned(m, dropped, replaced).orderBy("session", "seq").collect()]
    assert got == [("s", 0, "hi", []), ("s", 3, "why", ["c"]), ("s", 5, "[c]", []), ("t", 0, None, [])]


def test_ledger_nulls(spark):
    t = spark.createDataFrame([("a", 1, None, 4, None, None, None), ("a", 2, None, None, None, None, None), ("a", 3, None, 8, 10, 2, None), ("b", 1, "x", None, None, None, "s")],
                              "arm string, turn int, cell_id string, request_bytes bigint, prompt_tokens bigint, completion_tokens bigint, source string")
    rows = {(r.arm, r.turn): r for r in ledger.cumulative(ledger.decorated(t)).collect()}
    assert [rows["a", i].cumulative_prompt_tokens for i in (1, 2, 3)] == [None, None, 10] and [rows["a", i].cumulative_request_bytes for i in (1, 2, 3)] == [4, 4, 12]
    sums = {r.arm: r for r in ledger.totals(ledger.decorated(t)).collect()}
    assert sums["a"].token_source == "mixed" and sums["a"].cost is None and sums["b"].token_source == "bytes-estimate" and sums["b"].cost_estimated is None
    assert ledger.totals(ledger.decorated(t.limit(0))).count() == 0


def test_board_and_verdicts(spark):
    c = spark.createDataFrame([(1, "yes", "yes", False), (1, "n/a", "n/a", None), (2, "n/a", "n/a", None), (3, "yes", "no", None), (4, None, "yes", None), (5, "yes", "yes", True)], "task int, exact string, stdout string, missing boolean")
    got = {r.task: (r.verdict, r.reason) for r in ledger.board(c, ["task"]).collect()}
    assert got == {1: ("pass", "exact-current-and-stdout"), 2: ("fail", "missing-dump"), 3: ("fail", "assert-failed"), 4: ("fail", "missing-dump"), 5: ("fail", "missing-dump")}
    empty = spark.createDataFrame([], "candidate_bytes bigint, baseline_bytes bigint, required bigint, hits bigint, stale_units bigint, duplicate_units bigint")
    assert metrics.verdict(empty).first().verdict == "FAIL"


def test_percentiles_are_nearest_rank(spark):
    values = [5.0, 1.0, 3.0, 2.0, 4.0, 9.0, 7.0]
    r = metrics.distribution(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v").first()
    rank = lambda q: sorted(values)[max(0, math.ceil(len(values) * q) - 1)]
    assert (r.n, r.p50, r.p95, r.p99, r.min, r.max) == (7, rank(0.5), rank(0.95), rank(0.99), 1.0, 9.0)


def test_usage_and_redaction(spark):
    df = spark.createDataFrame([('{"usage": {"input_tokens": 5}}',), ('x "usage": {"prompt_tokens": 7',), ("none",), (None,)], "b string")
    got = [tuple(r.u) for r in df.select(ledger.usage(F.col("b")).alias("u")).collect()]
    assert got == [(5, None, "provider-response"), (7, None, "provider-response"), (None, None, "none"), (None, None, "none")]
    assert spark.range(1).select(ledger.redacted(F.lit('{"a":{"Token":"x","n":1}}'))).first()[0] == '{"a":{"Token":"[redacted]","n":1}}'


def test_provenance(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": 3}}',), ("no",), (None,)], "v string")
    assert [r[0] for r in df.select(provenance.canonical_json(F.col("v"))).collect()] == ['{"a":{"c":3,"d":2},"b":1}', None, None]
    assert df.select(provenance.binding_hash(F.col("v"))).first()[0] is not None
    assert spark.range(1).select(provenance.advancement_error(F.lit("candidate"), F.lit("sealed"))).first()[0] == "skip"


@pytest.mark.parametrize("fail_fast", [False, True])
def test_decoding_reports_errors(spark, fail_fast):
    df = spark.createDataFrame([(1, '<span-unit id="a" content-bytes="5">\nx'), (2, None), (3, "")], "k int, text string")
    out = project.decoded(df, "k", fail_fast=fail_fast)
    if fail_fast:
        with pytest.raises(Exception, match="truncated"):
            out.collect()
    else:
        assert [(r.k, r.error) for r in out.collect()] == [(1, "truncated unit content")]
