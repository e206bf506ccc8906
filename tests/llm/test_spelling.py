"""Spelling variants against brute force: near words, forms, roots, damaged runs, and all cases of tables."""

import random
import re
import zlib

import pytest

from spanview.llm import spelling
from spanview.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(docs, length=6, occurrences=5):
    out = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= length and n >= occurrences}


def is_near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(known, ratio=5):
    form, rows = {}, {}
    for w, n in known.items():
        near = [v for v in known if is_near(w, v)]
        best = min(near, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= ratio * n else None
        rows[w] = (n, len(near), form[w], known[form[w]] if form[w] else None)
    out = {}
    for w, (n, k, f, fn) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (f, root, n, k, fn)
    return out


def table_of(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("limit,paired,alphabet,least", [(4, 2, "abé", 1), (512, 8, "ab", 1), (2, 2, "abcdefghij", 3), (40, 1, "ab", 6)])
def test_groups_as_by_brute_force(spark, limit, paired, alphabet, least):
    r = random.Random(limit)
    known = {}
    while len(known) < 240:
        known["".join(r.choices(alphabet, k=r.randint(least, least + 4)))] = r.choice([1, 1, 2, 5, 30, 200, 200, 5000])
        if least <= 1 and len(known) >= 2 ** (least + 3):
            break
    got = table_of(spelling.grouped(spark.createDataFrame(list(known.items()), "word string, n long"), limit=limit, paired=paired))
    assert got == brute(known)


def test_chains_lead_to_their_ends(spark):
    words, n = ["a" * i + "z" * (30 - i) for i in range(1, 14)], 1
    known = {}
    for w in words:
        known[w], n = n, n * 6
    got = table_of(spelling.grouped(spark.createDataFrame(list(known.items()), "word string, n long")))
    assert got == brute(known)
    assert {x[1] for x in got.values()} == {words[-1]}


def test_one_block_holds_most_words(spark):
    """All words share both halves in turn: blocks of many thousands are cut without loss."""
    known = {"prefix" + format(i, "010b").replace("0", "x").replace("1", "y") + "suffix": i % 7 + 1 for i in range(1024)}
    df = spark.createDataFrame(list(known.items()), "word string, n long")
    got = table_of(spelling.grouped(df, limit=16, paired=4))
    assert all(x[3] == 10 for x in got.values())
    largest = max(max((r["count"] for r in b.filter("low < high").groupBy("m", "low", "high", "head", "tail").count().collect()), default=0) for b in spelling.blocks(written(df, "test"), 16))
    assert largest <= 16


def test_words_of_documents(spark):
    r = random.Random(3)
    runs = ["Straße", "straße", "ÀÉÎÖÜß", "connection", "conection", "Connexion", "x", "naïveté", "internationalisation", "×÷×÷×÷", "ŁŁŁŁŁŁ"]
    docs = [(i if i % 9 else None, r.choice([" ", "\n", "-", "7", "🙂"]).join(r.choices(runs, k=60))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "1 2 3 !"), (1003, "q" * 300_000), *[(1004, "q" * 300_000)] * 5, (1004, "q" * 299_999), *[(5, docs[5][1])] * 4]
    df = spark.createDataFrame([(*x, "w", 3) for x in docs], "doc_id long, text string, word string, n int")
    got = {x.word: x.n for x in spelling.words(df).collect()}
    want = brute_words(docs)
    assert got == want and "q" * 300_000 in got and any(len(w) == 5 + 1 for w in got)
    assert table_of(spelling.grouped(spelling.words(df))) == brute(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.words(docs).count() == 0
    assert spelling.grouped(spelling.words(docs)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.grouped(spelling.words(docs)).count() == 0


def test_query_meets_its_sql(spark, tmp_path):
    import duckdb

    base = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{base}/documents.parquet'")
    want = c.sql(f"select word, form, root, n, n_near, form_n from ({spelling.spelling_sql()})").fetchall()
    got = spelling.op11_spelling(spark, base).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and want
