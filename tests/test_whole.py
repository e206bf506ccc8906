"""Results that must be whole: values at any depth, groups across batches, ties, every document."""

import json
import random

import pytest

from spanview import families, registry
from spanview.operators import ledger, metrics, relocate, select, symbols

SECRETS = ("authorization", "cookie", "api_key", "api-key", "apikey", "token", "secret", "password")


def plain_redacted(value):
    if isinstance(value, dict):
        return {k: "[redacted]" if any(s in k.lower() for s in SECRETS) else plain_redacted(v) for k, v in value.items()}
    return [plain_redacted(x) for x in value] if isinstance(value, list) else value


def made(r, depth=0):
    kind = r.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return r.choice(["s3cr3t", 'a "token": "b"', "{", "x]", "", 5, -1.5e9, True, False, None])
    if kind == 4:
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b c", "X-Api-Key", "Authorization", "token", "max_tokens", "password2", 'q"t', "n", "Set-Cookie"]) + str(i): made(r, depth + 1) for i in range(r.randrange(5))}


def test_redaction_at_any_depth():
    r = random.Random(1)
    for _ in range(3000):
        value = {"top": made(r)}
        for body in (json.dumps(value), json.dumps(value, indent=2), json.dumps(value, separators=(",", ":"))):
            assert json.loads(ledger.redact(body)) == plain_redacted(value)
    assert ledger.redact('{"authorization":["Bearer abc123"],"token":{"v":"s3cr3t"},"n": 1}') == '{"authorization":"[redacted]","token":"[redacted]","n": 1}'
    assert ledger.redact('{"tok\\u0065n": "s"}') == '{"tok\\u0065n": "[redacted]"}'
    for cut in ('{"token": "s3', '{"token": {"a": "s3', '{"token": ["s3"', '{"token": s3'):
        assert "s3" not in ledger.redact(cut)
    assert ledger.redact("no json: token") == "no json: token" and ledger.redact("") == ""
    assert "x" not in ledger.redact('{"token": ' + "[" * 50_000 + '"x"')


def test_redaction_of_rows(spark):
    df = spark.createDataFrame([('{"a": [{"secret": [1, 2]}]}',), (None,), ("",)], "body string")
    assert [x[0] for x in df.select(ledger.redacted(df.body)).collect()] == ['{"a": [{"secret": "[redacted]"}]}', None, ""]


def test_budget_of_a_session_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = [(s, f"u{i:03}", 5, 1.0, "resolved", 0, 0, False, "text") for s in (None, "a", "b") for i in range(100)]
        df = spark.createDataFrame(rows, "session string, unit_id string, size int, score double, state string, change_count int, changed_at int, pinned boolean, content string")
        out = select.selected(df, turn=9, budget=100)
        assert out.columns == [*df.columns, "disposition", "used"]
        got = out.collect()
        for s in (None, "a", "b"):
            own = sorted((x for x in got if x.session == s), key=lambda x: x.unit_id)
            assert [x.disposition for x in own] == ["selected"] * 20 + ["budget"] * 80 and own[-1].used == 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_selection_deals_out_no_texts(spark):
    df = spark.createDataFrame([("a", "u", 5, 1.0, "resolved", 0, 0, False, "text")], "session string, unit_id string, size int, score double, state string, change_count int, changed_at int, pinned boolean, content string")
    plan = select.selected(df, 9)._jdf.queryExecution().optimizedPlan().toString()
    fold = plan[plan.index("MapInArrow") :]
    assert "RepartitionByExpression" in fold and "content" not in fold.split("LogicalRDD")[0]


def regions(spark, r, n=150):
    rows = []
    for i in range(n):
        pool = ["{", "}", "", "a b", "c", "d  e", "f", f"u{i}", f"v{i}"]
        content = [r.choice(pool) for _ in range(r.randrange(1, 7))]
        now = [r.choice([*pool, f"x{j}"]) for j in range(r.randrange(25))]
        at = r.randrange(len(now) + 1)
        now[at:at] = [x if r.random() < 0.8 else "changed" for x in content]
        rows.append((i, "\n".join(content), "\n".join(now), r.randrange(1, 9)))
    df = spark.createDataFrame(rows, "id int, content string, current string, start_line int")
    return rows, df.withColumn("anchors", relocate.anchors(df.content, df.start_line))


def normal(text):
    return [" ".join(x.split()) for x in text.split("\n")]


def test_boundary_pairs_by_brute_force(spark):
    rows, df = regions(spark, random.Random(2))
    got = {}
    for x in relocate.boundary_pairs(df, ["id"]).collect():
        got.setdefault(x.id, []).append(x)
    found = 0
    for i, content, current, start in rows:
        own, now = normal(content), normal(current)
        full = [x for x in own if x]
        pairs = []
        if full:
            pairs = sorted((abs(e - s + 1 - len(own)), abs(s + 1 - start), s, e) for s, x in enumerate(now) for e, y in enumerate(now) if e >= s and x == full[0] and y == full[-1])
        mine = sorted(got.get(i, []), key=lambda x: x.rank)
        assert bool(mine) == bool(pairs), i
        if pairs:
            best = mine[0]
            assert (best.span_delta, best.distance, best.start_at, best.end_at, best.rank) == (*pairs[0], 1)
            assert best.tied == (sum(p[:2] == pairs[0][:2] for p in pairs) > 1)
            assert {(x.span_delta, x.distance, x.start_at, x.end_at) for x in mine} <= set(pairs)
            found += 1
    assert found > 60


def test_votes_by_brute_force(spark):
    rows, df = regions(spark, random.Random(3))
    got = {}
    for x in relocate.consensus_votes(df, ["id"]).collect():
        got.setdefault(x.id, []).append((x.rank, x.start_at, x.support, x.interior))
    for i, content, current, start in rows:
        own, now = normal(content), normal(current)
        full = [j for j, x in enumerate(own) if x]
        votes = {}
        for j in full:
            if now.count(own[j]) == 1:
                s = now.index(own[j]) - j
                if 0 <= s <= len(now) - len(own):
                    votes.setdefault(s, []).append(j in (full[0], full[-1]))
        order = sorted(votes, key=lambda s: (-len(votes[s]), abs(s + 1 - start), s))
        assert sorted(got.get(i, [])) == [(k + 1, s, len(votes[s]), votes[s].count(False)) for k, s in enumerate(order)], i
    assert len(got) > 60


@pytest.mark.parametrize("name", ["consensus_votes", "anchor_best_unique"])
def test_votes_and_pairs_need_no_shuffle(spark, tmp_path, name):
    spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_variants_of_families():
    text = "import os\n\n\ndef alpha(x):\n    y = x + 1\n    z = y * 2\n    return z\n\n\ndef beta(x):\n    return x\n"
    names = {t["name"].split("/")[1] for t in families.generate({"a.py": text}, "a.py", 4, 7)}
    assert {"insert-before-unique-last", "delete-fail-close", "duplicate-boundary-markers"} <= names


def test_symbols_by_indentation_and_by_the_parser():
    source = "import os\n\n\nclass A:\n    x = 1\n\n    def m(self):\n        # note\n        if x:\n            return 1\n\n        return 2\n\n    async def n(self): pass\n\n\ndef f(a,\n      b):\n    def g():\n        return 1\n    return g\n# end\n"
    one, two = symbols.enumerate_symbols("a.py", source)["units"], symbols.indented_symbols("a.py", source)["units"]
    fields = ("kind", "qualified_selector", "start_line", "end_line", "sha256", "byte_start", "byte_end")
    assert [[u[f] for f in fields] for u in one] == [[u[f] for f in fields] for u in two] and len(one) == 5


def test_a_parser_may_take_so_long_and_give_so_much():
    def slow(path, text):
        while True:
            pass

    with pytest.raises(TimeoutError):
        symbols.limited(slow, seconds=0.2)("a.py", "")
    with pytest.raises(ValueError):
        symbols.limited(symbols.enumerate_symbols, most=10)("a.py", "def f():\n    pass\n")
    assert symbols.limited(symbols.enumerate_symbols)("a.py", "def f():\n    pass\n")["error"] is None


def test_pareto_by_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(300) / 7, float(r.randrange(400))) for i in range(500)] + [(500, None, 1.0), (501, 2.0, None)]
    got = {x.id for x in metrics.pareto(spark.createDataFrame(rows, "id int, cost double, gain double"), "cost", "gain").collect()}
    whole = [x for x in rows if None not in x]
    assert got == {i for i, c, g in whole if not any(d <= c and h >= g and (d < c or h > g) for _, d, h in whole)} and len(got) > 2
    assert metrics.pareto(spark.createDataFrame([], "id int, cost double, gain double"), "cost", "gain").count() == 0
