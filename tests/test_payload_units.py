"""Units of payloads against the decoder that reads one payload at a time, and case by case."""

import random

from spanview import engine
from spanview.operators import payload_units as pu


def frame(i, content, size=None, path="a.py", tag=engine.UNIT_TAG):
    n = len(content.encode()) if size is None else size
    return f'<{tag} id="u{i}" path="{path}" content-bytes="{n}">\n{content}\n</{tag}>'


def by_decoder(payload):
    try:
        return [(i, u.get("id"), u.get("path"), u["content"], u["content_bytes"], None) for i, u in enumerate(engine.decode(payload or ""))]
    except engine.FrameError as e:
        return [(0, None, None, None, None, str(e))]


def test_framed_as_the_decoder(spark):
    r, payloads = random.Random(3), []
    bits = ["", "x", "é 語 😀", "a\n\nb", frame(9, "inner é"), "</span-unit>", "\n</span-unit>", "<span-unit ", ">\n", '<span-unit id="z">\n', "&lt;&quot;"]
    for i in range(250):
        parts = []
        for k in range(r.randrange(5)):
            content = "".join(r.choice(bits) for _ in range(r.randrange(4)))
            size = None if r.random() < 0.85 else r.choice([0, 1, 5, 10_000, len(content)])
            parts.append(r.choice(["", "text ", "é\n"]) + frame(k, content, size, r.choice(["a.py", "d&amp;e &lt;x&gt;.py", "ü/é.py"])))
        payloads.append((i, "\n".join(parts) + r.choice(["", "tail", "<span-unit id=\"q\"", '<span-unit content-bytes="x">\n', '<span-unit other-id="n" id="y" content-bytes="0" id="last">\n\n</span-unit>'])))
    payloads += [(900, None), (901, ""), (902, "no frame"), (903, frame(1, "x" * 200_000) + frame(2, "y"))]
    got = {}
    for x in pu.framed(spark.createDataFrame(payloads, "i long, payload string")).collect():
        got.setdefault(x.i, []).append((x.place, x.id, x.path, x.content, x.bytes, x.error))
    want = {i: w for i, p in payloads if (w := by_decoder(p))}
    assert {i: sorted(v, key=lambda x: x[0]) for i, v in got.items()} == want
    assert sum(w[0][-1] is not None for w in want.values()) > 40 and sum(len(w) for w in want.values()) > 200


def test_marks_and_blocks(spark):
    payload = 'sync: a\n\nTASK: t\n\n[whole-file path="a.py"]\nx = 1\n\n\n[whole-file path="b é.py"]é\nsync: c\nrest'
    df = spark.createDataFrame([("s", payload), ("n", None)], "k string, payload string")
    assert [tuple(x) for x in pu.marked(df).orderBy("place").collect()] == [("s", 0, "file:a.py", "a.py", "x = 1", 5, None), ("s", 1, "file:b é.py", "b é.py", "é", 2, None)]
    text = "first\nblock\n\n \n\nTASK: no\n\n[span:u path=a] mark\n\nhas <span-unit in it\n\né\n\n"
    got = [(x.place, x.content, x.bytes) for x in pu.blocks(spark.createDataFrame([("s", text)], "k string, payload string")).orderBy("place").collect()]
    assert got == [(0, "first\nblock", 11), (1, "é", 2)]
    rows = [("unit-file", frame(1, "a")), ("whole-file", payload), ("append-only", text), ("observation-mask", text)]
    out = pu.units(spark.createDataFrame(rows, "system string, payload string")).groupBy("system").count().collect()
    assert {x.system: x["count"] for x in out} == {"unit-file": 1, "whole-file": 2, "append-only": 2}
    assert pu.units(spark.createDataFrame([], "system string, payload string")).count() == 0


def test_no_python_workers(spark):
    df = pu.units(spark.createDataFrame([("unit-file", frame(1, "a"))], "system string, payload string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
