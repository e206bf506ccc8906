"""Edit scripts: valid, minimal where nothing moved, never better than the optimum, whole for all cases of texts."""

import random

import numpy as np
import pytest

from spanview.operators import diffs


def optimum(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + len(x.encode()) + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def edited(r, lines, moves):
    out = list(lines)
    for _ in range(r.randrange(6)):
        at, kind = r.randrange(len(out) + 1), r.random()
        if kind < 0.3:
            out[at:at] = [r.choice(["new", "", "}", "added é"])] * r.randrange(1, 4)
        elif kind < 0.6:
            del out[at : at + r.randrange(1, 4)]
        elif kind < 0.8 and at < len(out):
            out[at] += "!"
        elif moves and len(out) > 4:
            part = out[at : at + 3]
            del out[at : at + 3]
            to = r.randrange(len(out) + 1)
            out[to:to] = part
    return out


@pytest.mark.parametrize("moves", [False, True])
def test_scripts_are_valid_and_minimal(spark, moves):
    r = random.Random(11 + moves)
    rows = []
    for i in range(150):
        lines = [r.choice(["", "}", "  return", f"line {j} of {i}", f"line {j} of {i}", f"ligne é {j}"]) for j in range(r.randrange(1, 40))]
        rows.append((i, "\n".join(lines), "\n".join(edited(r, lines, moves))))
    rows += [(900, None, ""), (901, "", "a"), (902, "a", None), (903, "same\nsame", "same\nsame"), (904, "a\r\nb", "a\nb"), (905, "\n\n\n", "\n"), (906, "x\n" * 3000, "y\n" + "x\n" * 2990), (907, "a\nb\nc", "c\nb\na")]
    df = spark.createDataFrame(rows, "id long, before string, after string")
    scripts, less = {}, 0
    for x in diffs.matched_lines(df).collect():
        scripts.setdefault(x.id, []).append((x.i, x.j, x.weight))
    for i, before, after in rows:
        a, b, script = (before or "").split("\n"), (after or "").split("\n"), sorted(scripts.get(i, []))
        assert all(a[x] == b[y] and w == len(a[x].encode()) + 1 for x, y, w in script)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(script, script[1:]))
        kept, best = sum(w for *_, w in script), optimum(a, b)
        assert kept <= best
        less += kept < best
    assert less <= (8 if moves else 0)


def test_chains_by_brute_force():
    r = random.Random(5)
    for _ in range(200):
        n = r.randrange(1, 9)
        points = list(zip(range(n), r.sample(range(20), n), (r.randrange(1, 9) for _ in range(n))))
        best = max(sum(p[2] for p in s) for m in range(1, 2**n) for s in [[points[k] for k in range(n) if m >> k & 1]] if all(x[1] < y[1] for x, y in zip(s, s[1:])))
        got = diffs.heaviest_chain(points)
        assert sum(p[2] for p in got) == best and all(x[1] < y[1] for x, y in zip(got, got[1:]))


def test_common_lines_in_one_row():
    r = random.Random(6)
    for _ in range(100):
        a, b = (np.array([r.randrange(3) for _ in range(r.randrange(14))]) for _ in "ab")
        weights = np.array([(1, 4, 9)[x] for x in a], dtype=np.int64)
        got = diffs.common_lines(a, b, weights)
        names = ["", "aaa", "a" * 8]
        assert sum(weights[i] for i, _ in got) == optimum([names[x] for x in a], [names[x] for x in b]) and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_changes_and_clashing_columns(spark):
    rows = [("k", 7, "a\nb\nc", "a\nB\nc\nd"), (None, 7, None, None), ("k", 7, "a\nb\nc", "a\nB\nc\nd"), ("z", 1, "p\nq", "q")]
    got = sorted(map(tuple, diffs.changed(spark.createDataFrame(rows, "id string, weight int, before string, after string")).drop("before", "after").collect()), key=repr)
    assert got == sorted([("k", 7, 2, 4, 2), (None, 7, 0, 0, 0), ("k", 7, 2, 4, 2), ("z", 1, 2, 0, 1)], key=repr)
    assert diffs.changed(spark.createDataFrame([], "before string, after string")).count() == 0
    one = spark.createDataFrame([(1, "a\nb\nc", "a\nX\nc\nd")], "id long, before string, after string")
    assert sorted(map(tuple, diffs.hunks(one, diffs.matched_lines(one)).collect())) == [(1, 1, 2, 1, 2), (1, 3, 3, 3, 4)]


def test_no_text_is_written_or_moved(spark, monkeypatch):
    kinds, own = [], diffs.cut
    monkeypatch.setattr(diffs, "cut", lambda df, name: kinds.append((name, df.schema.simpleString())) or own(df, name))
    rows = [(i, "\n".join(f"line {j % 7} of {i}" for j in range(i)), "\n".join(f"line {j % 5} of {i}" for j in range(i + 2))) for i in range(20)] + [(50, None, "a"), (51, "é\r", "é\r\n")]
    df = spark.createDataFrame(rows, "k long, before string, after string")
    slim = diffs.changed(df, texts=False)
    assert kinds and not any("string" in kind or "binary" in kind for _, kind in kinds)
    assert "before" not in slim.columns and sorted(map(repr, slim.collect())) == sorted(map(repr, diffs.changed(df).drop("before", "after").collect()))
    assert {(x.k, x.before, x.after) for x in diffs.changed(df).collect()} == set(rows)
