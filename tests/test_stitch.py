"""Partial reads: their kinds case by case, and texts cut into parts and put together again."""

import random

from spanview.operators import stitch

MORE = "\n\n[{} more lines in file. Use offset={} to continue.]"


def test_kinds_of_reads(spark):
    more = "a\nb" + MORE.format(7, 12)
    cases = [
        # asked, offset, limit, start, end, truncated, content -> scope, first, last, file_lines, issue, body
        ((None, None, None, None, None, None, "a\nb"), ("file", None, None, None, None, "a\nb")),
        ((None, None, None, None, None, True, "a"), ("file", None, None, None, "truncated", "a")),
        ((None, 10, 2, None, None, False, more), ("region", 10, 11, 18, None, "a\nb")),
        ((None, 1, 2, None, None, False, "a\nb"), ("file", None, None, None, None, "a\nb")),
        ((None, 10, 2, None, None, False, "a\nb"), ("file", None, None, None, "open-start", "a\nb")),
        ((None, 10, None, None, None, False, "a"), ("file", None, None, None, "partial", "a")),
        ((None, None, 2, None, None, False, more), ("file", None, None, None, "partial", "a\nb")),
        ((None, None, 2, None, None, False, "a"), ("file", None, None, None, None, "a")),
        ((None, 0, -3, None, None, False, "a"), ("file", None, None, None, None, "a")),
        (("region", None, None, 4, 9, False, more), ("region", 4, 9, None, None, "a\nb")),
        (("region", 10, None, 4, 9, True, "a"), ("region", 4, 9, None, "truncated", "a")),
        (("symbol", 10, 2, None, None, False, "a"), ("symbol", None, None, None, None, "a")),
        ((None, 10, 2, None, None, True, "a"), ("region", 10, 11, None, "truncated", "a")),
        ((None, 1, 1, None, None, False, None), ("file", None, None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, asked string, offset long, limit long, start_line long, end_line long, truncated boolean, content string")
    got = {x.i: (x["scope"], x.first_line, x.last_line, x.file_lines, x.issue, x.body) for x in stitch.classified(df).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def pages(r, lines, hole):
    """Reads (offset, limit, content) that page through lines with overlaps; without the lines of hole."""
    out, at = [], 0
    while at < len(lines) or not out:
        n = r.randrange(1, 6)
        stop = min(len(lines), at + n)
        if not any(at <= h < stop for h in hole):
            body, left = "\n".join(lines[at:stop]), len(lines) - stop
            out.append((at + 1, n, body + (MORE.format(left, stop + 1) if left else "")))
        at = stop if stop == len(lines) else max(at + 1, stop - r.randrange(0, 2))
    return out


def test_parts_come_back_whole_and_gaps_are_named(spark):
    r, rows, want = random.Random(7), [], {}
    for k in range(120):
        lines = [r.choice(["", "x", "é 語", f"line {i}"]) for i in range(r.randrange(1, 25))]
        hole = set(range(5, 5 + r.randrange(1, 4))) if r.random() < 0.3 and len(lines) > 12 else set()
        parts = pages(r, lines, hole)
        r.shuffle(parts)
        rows += [("s" if k % 5 else None, f"p{k}", *p) for p in parts + parts[: r.randrange(2)]]
        seen = {o - 1 + i for o, _, c in parts for i in range(len(c.split("\n\n[")[0].split("\n")) if "more lines" in c else len(c.split("\n")))}
        missing = [i + 1 for i in range(len(lines)) if i not in seen]
        gaps = []
        for i in missing:
            if gaps and gaps[-1][1] == i - 1:
                gaps[-1][1] = i
            else:
                gaps.append([i, i])
        want[f"p{k}"] = ("\n".join(lines) if not missing else None, [tuple(g) for g in gaps], "gap" if missing else None, len(rows))
    df = spark.createDataFrame(rows, "session string, path string, offset long, limit long, content string")
    got = {x.path: (x.text, [tuple(g) for g in x.gaps], x.issue) for x in stitch.stitched(stitch.as_parts(df)).collect()}
    assert got == {p: w[:3] for p, w in want.items()} and sum(w[2] is not None for w in want.values()) > 10


def test_conflicts_and_open_ends(spark):
    parts = [
        ("s", "differ", 1, "a\nb", None, False), ("s", "differ", 2, "B\nc", None, True),
        ("s", "ends", 1, "a", 5, False), ("s", "ends", 1, "a\nb", None, True),
        ("s", "beyond", 1, "a\nb\nc", 2, False),
        ("s", "open", 1, "a\nb", None, False),
        ("s", "tail", 1, "a", 4, False), ("s", "tail", 3, "c", 4, False),
        ("s", "nothing", 1, None, None, True), ("s", "empty", 1, "", None, True), ("s", "low", -3, "a", None, None), ("s", "low", None, "a", None, True),
    ]
    df = spark.createDataFrame(parts, "session string, path string, first long, content string, file_lines long, ends boolean")
    got = {x.path: (x.issue, x.text, [tuple(g) for g in x.gaps]) for x in stitch.stitched(df).collect()}
    assert got == {
        "differ": ("conflict", None, []), "ends": ("conflict", None, []), "beyond": ("conflict", None, []), "open": ("open-end", None, []),
        "tail": ("gap", None, [(2, 2), (4, 4)]), "empty": (None, "", []), "low": (None, "a", []),
    }
    assert stitch.stitched(df.limit(0)).count() == 0
