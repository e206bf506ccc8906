"""Packing by the configuration program: places, cuts, ids, bounds, and all cases of tables."""

import itertools
import random
import zlib

import numpy as np
import pytest

from spanview.llm import lp_packing as lp
from spanview.llm.common import written
from spanview.llm.tokens import TOKENIZERS

JSON = f"{TOKENIZERS}/{lp.VOCABULARY}"


def histogram(lengths):
    out = {}
    for n in lengths:
        out[n] = out.get(n, 0) + 1
    return out


def held(groups, most):
    assert all(sum(n * k for n, k in filling) <= most and t > 0 for filling, t in groups)
    out = {}
    for filling, t in groups:
        for n, k in filling:
            out[n] = out.get(n, 0) + k * t
    return out, sum(t for _, t in groups)


def fewest(lengths, most):
    """The least number of bins, by search."""
    lengths = sorted(lengths, reverse=True)

    def fits(i, free):
        if i == len(lengths):
            return True
        tried = set()
        for b in range(len(free)):
            if free[b] >= lengths[i] and free[b] not in tried:
                tried.add(free[b])
                free[b] -= lengths[i]
                if fits(i + 1, free):
                    return True
                free[b] += lengths[i]
        return False

    return next(k for k in itertools.count(-(-sum(lengths) // most)) if fits(0, [most] * k))


def test_knapsack_by_brute_force():
    r = random.Random(2)
    for _ in range(30):
        values = np.array([0.0] + [r.choice([0.0, r.random()]) for _ in range(20)])
        found = lp.Knapsack(values, 20)
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1]] + [values[n] + best[c - n] for n in range(1, c + 1)])
        assert np.allclose(found.best, best)
        filled = found.filled(20)
        assert sum(n * k for n, k in filled.items()) <= 20 and np.isclose(sum(values[n] * k for n, k in filled.items()), best[20])


def test_small_histograms_need_the_fewest_or_one_more():
    r, exact = random.Random(4), 0
    for _ in range(40):
        lengths = [r.randrange(1, 31) for _ in range(r.randrange(1, 13))]
        want = fewest(lengths, 30)
        got, n = held(lp.rounded(histogram(lengths), 30, 20), 30)
        assert got == histogram(lengths) and want <= n <= want + 1
        assert lp.solved(histogram(lengths), 30, 20)[1] <= want + 1e-9
        exact += n == want
    assert exact >= 36


def test_best_fit_of_groups_is_that_of_single_pieces():
    r = random.Random(5)
    for _ in range(60):
        lengths = [r.choice((3, 5, 7, 11, 12, 20)) for _ in range(r.randrange(60))]
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free[free.index(min(fits))] -= n
            else:
                free.append(30 - n)
        got, n = held(lp.best_fit(histogram(lengths), 30), 30)
        assert got == histogram(lengths) and n == len(free)


def test_near_the_bound_and_below_best_fit():
    r = random.Random(1)
    for lengths in ([r.randint(300, 1500) for _ in range(50_000)], [min(2048, max(1, int(r.lognormvariate(6.5, 0.8)))) for _ in range(60_000)]):
        h = histogram(lengths)
        got, n = held(lp.rounded(h), 2048)
        plain = sum(t for _, t in lp.best_fit(h))
        assert got == h and -(-sum(lengths) // 2048) <= n < plain and n <= 1.002 * sum(lengths) / 2048


def test_no_pieces_and_one_length():
    assert lp.rounded({}) == [] and lp.solved({}) == ({}, 0.0)
    assert held(lp.rounded({2048: 7}), 2048) == ({2048: 7}, 7)
    assert held(lp.rounded({1: 5000}), 2048) == ({1: 5000}, 3)


def test_pieces():
    assert lp.pieces(1, 8) == [(0, 1)] and lp.pieces(8, 8) == [(0, 8)] and lp.pieces(9, 8) == [(0, 1), (1, 8)] and lp.pieces(24, 8) == [(0, 8), (8, 8), (16, 8)]


def whole(rows, texts, length):
    """Checks the rows against the ids of texts (a list of (doc_id, text)) by the tokenizers library."""
    from tokenizers import Tokenizer

    known, want = Tokenizer.from_file(JSON), []
    for doc_id, text in texts:
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % length or min(length, len(ids))
        for i, at in enumerate([0, *range(first, len(ids), length)]):
            part = ids[at : first if i == 0 else at + length]
            want.append((doc_id, i, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=key) == sorted(want, key=key)
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(spans)


@pytest.mark.parametrize("length", [16, 64, 2048])
def test_documents_are_packed_whole(spark, length):
    r = random.Random(length)
    texts = [(i, r.choice(["one ", "wörd 語 😀 ", "it's <|endoftext|> ", "12 34\n\n"]) * r.randrange(60)) for i in range(200)]
    texts += [(900, None), (901, ""), (None, "no id"), (902, "same"), (902, "same"), (903, "x" * 50_000), (904, " " * 200_000 + "y")] + [(1000 + i, "a copy of one text") for i in range(300)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in texts], "doc_id long, text string, rank string, length int").repartition(5)
    rows = lp.assigned(written(lp.measured(df, length), "test"), length, 10).collect()
    n = whole(rows, texts, length)
    assert n <= 1.06 * sum(x.length for x in rows) / length + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = lp.assigned(written(lp.measured(docs), "test"))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_query_over_the_smallest_tables(spark):
    base = "/root/testdata/sf0.001"
    rows = lp.op12_lp_packing(spark, base).collect()
    texts = [tuple(x) for x in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    assert whole(rows, texts, 2048) <= 1.02 * sum(x.length for x in rows) / 2048 + 1
