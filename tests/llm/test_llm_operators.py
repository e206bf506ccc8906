"""The ten operators on small tables: brute force, nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import base64
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanview.llm import decontaminate, embedding_dedup, html_text, language_id, license_scan, mixing, packing, secret_scan, simhash, warc
from spanview.llm.common import new_path
from spanview.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(300, 360)] + [(400, x) for x in range(401, 460)]
    df = spark.createDataFrame([*pairs, (None, 5), (7, 7)], "a bigint, b bigint")
    want = union(500, pairs)
    got = {x.node: x.component for x in components(df).collect()}
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert components(df.limit(0)).count() == 0


# 1 ---------------------------------------------------------------------------


def vectors(r, n=400, d=16):
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            v = out[r.integers(len(out))][1]
            v = v if r.random() < 0.2 else [float(x) for x in np.float32(np.array(v) + r.normal(size=len(v)) * r.choice([0.01, 0.05, 0.1]))]
        else:
            v = [float(x) for x in np.float32(r.normal(size=d))]
        out.append((i, v, int(r.integers(3)) if r.random() < 0.95 else None))
    return out


def brute_links(rows, cosine=0.98):
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    unit = [np.array(v) / np.linalg.norm(v) if k else None for (_, v, _), k in zip(rows, ok)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    root = union(len(rows), pairs)
    return {rows[i][0]: (links[i], rows[root[i]][0], rows[root[i]][0] == rows[i][0]) for i in range(len(rows))}


@pytest.mark.parametrize("block", [8, 2048])
def test_vectors_link_as_by_brute_force(spark, block):
    rows = vectors(np.random.default_rng(block))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None, 1.0], 1), (n + 5, rows[0][1][:5], 0), (n + 6, rows[0][1], rows[0][2]), (n + 7, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, block string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked(df, block=block).collect()}
    assert got == brute_links(rows)
    assert sum(x[0] for x in got.values()) > 100


def test_a_block_of_near_copies_gives_a_forest():
    r = np.random.default_rng(6)
    raw = np.float32(r.normal(size=(1, 32)) + 0.01 * r.normal(size=(2000, 32)))
    uids, ones = np.arange(2000, dtype="<i8").tobytes(), np.ones(2000, dtype="<i8").tobytes()
    x, y = (embedding_dedup.Interval(32, raw.tobytes(), False, u, ones, {}) for u in (uids, np.arange(2000, 4000, dtype="<i8").tobytes()))
    began = time.process_time()
    edges = embedding_dedup.join_intervals(x, x, 0.98, 0.21)
    across = embedding_dedup.join_intervals(x, y, 0.98, 0.21)
    assert time.process_time() - began < 5 and x.links.min() == x.links.max() == 3999 and y.links.min() == 2000
    assert len(edges) == 1999 and len(set(union(2000, edges))) == 1 and len(set(union(4000, across))) == 1


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert embedding_dedup.linked(df).count() == 0


# 2 ---------------------------------------------------------------------------


def test_best_fit_decreasing_by_brute_force():
    r = random.Random(3)
    for _ in range(100):
        lengths, most = [r.randrange(1, 31) for _ in range(r.randrange(40))], 30
        free: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free[free.index(min(fits))] -= n
            else:
                free.append(most - n)
        bins = packing.best_fit_decreasing(lengths, most)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(most - sum(lengths[i] for i in b) for b in bins) == sorted(free)


def test_packing_is_lossless(spark):
    texts = ["short", None, "", "wörd 語 😀 " * 900, "same", "same", "x" * 5000] + [f"text number {i} " * (i % 30) for i in range(80)]
    df = spark.createDataFrame([(i if i != 2 else None, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    rows = packing.packed(df, length=128, window=2000).collect()
    known, parts = packing.byte_bpe(f"{packing.TOKENIZERS}/{packing.VOCABULARY}"), {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1] and set(ids[r.n_tokens :]) <= {packing.END}
        for a, b, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.segments):
            assert s.n == b - a
            parts.setdefault(s.doc_id, []).append((s["first"], ids[a:b].tolist()))
    for i, t in enumerate(texts):
        ids = [x for _, part in sorted(parts[i if i != 2 else None]) for x in part]
        assert ids[-1] == packing.END and known.encoding.decode(ids[:-1]) == (t or "")
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    assert packing.packed(df.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------

WORDS = {"aa": "kala muna rotu seli vado".split(), "bb": "strick grumpf knolz bratz wunz".split()}


def labelled(spark, n=120):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS[l]) for _ in range(r.randrange(3, 40))), l, "s", 1) for i in range(n) for l in [r.choice(("aa", "bb"))]]
    rows += [(n, None, "aa", "s", 0), (n + 1, "", "bb", None, 0), (n + 2, "123 !!", "aa", "s", 0), (n + 3, "KALA MUNA! " * 30_000, "aa", "s", 0), (n + 4, "kala muna", None, "s", 0), (n + 4, "kala muna", None, "s", 0), (None, "strick grumpf", "bb", "s", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_language_id(spark):
    df = labelled(spark).withColumn("score", F.lit("old"))
    out = language_id.identify(df, language_id.fit(language_id.training_rows(df))).collect()
    assert len(out) == df.count()
    for r in out:
        if not r.text or not re.search("[a-z]", r.text.lower()):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == ("aa" if r.text.lower().split()[0].strip("!") in WORDS["aa"] else "bb") and 0 <= r.score <= 1
    docs = labelled(spark)
    kept = language_id.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    empty = df.limit(0)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, []).collect()} == {"und"}


def test_language_id_learns_from_training_rows_only(spark):
    df = spark.createDataFrame([(i,) for i in [*range(2000), None]], "doc_id bigint")
    import zlib

    got = {r.doc_id: r.h for r in df.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(2000)) and got[None] is False


# 4 ---------------------------------------------------------------------------


def test_decontamination(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[r.choice(vocabulary) for _ in range(r.randrange(15, 40))] for _ in range(30)]
    rows, want = [], set()
    for i in range(200):
        body = [r.choice(vocabulary) for _ in range(r.randrange(5, 300))]
        if i % 4 == 0:
            part, kind = list(items[i % 30]), i % 12
            if kind == 4:  # a fifth of the words replaced
                for p in r.sample(range(len(part)), len(part) // 5):
                    part[p] = f"sub{p}"
            if kind == 8:  # one word lost
                part.pop(len(part) // 2)
            at = r.randrange(len(body) + 1)
            body[at:at] = part
            want.add(i)
        if i % 4 == 1:  # a third of a passage is no leak
            body += items[i % 30][: len(items[i % 30]) // 3]
        rows.append((i, ", ".join(body).upper() if i % 3 else " ".join(body)))
    rows += [(900, None), (901, ""), (902, "..."), (None, " ".join(items[0])), (0, rows[0][1])]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id bigint, text string, overlap string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, "w1 w2"), (97, " ".join(items[3]))], "item_id bigint, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {x.doc_id for x in got} == want | {None} and sum(x.doc_id == 0 for x in got) == 2
    assert {3, 97} <= set(next(x for x in got if x.doc_id == 180 or 3 in x.item_ids).item_ids) or all(3 not in x.item_ids for x in got)
    clean = decontaminate.cleaned(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len(got)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_masks_hit_all_fifths_of_replaced_words():
    from itertools import combinations

    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for n in (15, 16, 20):
        for lost in combinations(range(n), n // 5):
            assert any(all(i + p not in lost for p in m) for m in masks for i in range(n - m[-1]))


# 5 ---------------------------------------------------------------------------


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<body></body>", ""), ("just text &amp; more", "just text & more"),
    ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>One <b>two</b>\n three.<p>Four&nbsp;five.</article><footer>f</footer>", "T One two three. Four five."),
    ("<body><div class=ad>Buy</div><div id=main><p>Long paragraph of text that goes on and on.</p><p>Another long one, with words.</p></div><aside>side</aside><form>f</form>", "Long paragraph of text that goes on and on. Another long one, with words."),
    ("<body><article><p>A first paragraph of the story, long.</p><section id='comments'><p>a reader's comment</p></section><p>Last paragraph of the story.</p></article>", "A first paragraph of the story, long. Last paragraph of the story."),
    ("<body><div class='site-header'>Site</div><article><div class='entry-header'><h2>Head</h2></div><div class='notice'>Mind</div><p>The text of it is here, and long enough.</p></article></body>", "Head The text of it is here, and long enough."),
    ("<article><p>x < y and a <script>var p='<p>no</p>'</script>b</p></article>", "x < y and a b"),
    ("<article><ul><li>one<li>two</ul><pre>a\n  b</pre>", "one two a b"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_pages(spark):
    body = "<p>" + "word " * 50_000 + "</p>"
    rows = [(1, "u", f"<html><body><header>H</header><article>{body}</article></body>", "x"), (1, "u", None, "x"), (2, None, "<div " * 3000, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, main_text string")
    got = html_text.extracted(df).collect()
    assert got[0].main_text == ("word " * 50_000).strip() and got[1].main_text == "" and len(got) == 3
    assert html_text.extracted(df.limit(0)).count() == 0


# 6 ---------------------------------------------------------------------------


def plain_targets(sizes, weights, repeats=3):
    """Targets by capping and sharing again, round by round."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > repeats * sizes[i]}
        for i in above or open_:
            out[i] = float(repeats * sizes[i]) if above else left * weights[i] / total
        if not above:
            break
        left, open_ = left - sum(out[i] for i in above), open_ - above
    return out


def plain_seats(shares, seats, caps):
    """Seats one by one, each to the highest quotient."""
    out = [0] * len(shares)
    for _ in range(seats):
        free = [i for i in range(len(shares)) if out[i] < caps[i] and shares[i] > 0]
        if not free:
            break
        out[max(free, key=lambda i: (shares[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_targets_and_seats_by_brute_force(spark):
    r = random.Random(17)
    for n in (0, 1, 40):
        sizes = [r.choice([0, 1, 50, 50, 50, 333, 5000]) for _ in range(n)]
        rows = [(None if i == n - 1 else f"s{i:03}", x, 1) for i, x in enumerate(sizes)]
        r.shuffle(rows)
        sums = spark.createDataFrame(rows, "source string, source_size bigint, n bigint")
        sources = mixing.with_targets(mixing.ordered(sums.repartition(5)))
        got = sorted(sources.collect(), key=lambda x: x.place)
        assert [x.place for x in got] == list(range(n)) and [x.source_size for x in got] == sizes
        want = plain_targets(sizes, [i % 3 + 1 for i in range(n)])
        assert [x.target for x in got] == pytest.approx(want)
        caps = [-(-3 * x // 32) for x in sizes]
        for seats in {0, 1, sum(sizes) // 32, sum(caps) + 5}:
            blocks = mixing.with_blocks(sources, seats, F.ceil(F.col("source_size") * 3 / 32)).orderBy("place").collect()
            assert [x.blocks for x in blocks] == plain_seats([x.target for x in got], seats, caps), (n, seats)
            assert mixing.sainte_lague(np.array(sizes), seats, np.array(caps, dtype=np.int64)).tolist() == plain_seats(sizes, seats, caps)


def test_mix_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 900)
    r = random.Random(18)
    rows = [(i if r.random() < 0.9 else None, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(0, 90))), "en", r.choice(["a", "b", "b", "b", "c", None]), 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(df, block=8).withColumn("hash", F.xxhash64("doc_id", "text", F.lit(mixing.SEED))).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = ["a", "b", "c", None]
    sums = [sum(size(x[1]) for x in rows if x[3] == n) for n in names]
    want = plain_targets(sums, [1, 2, 3, 1])
    blocks = plain_seats(want, round(sum(sums) / 8), [-(-3 * n // 8) for n in sums])
    starts = {}
    for k, name in enumerate(names):
        shards = max(1, -(-sums[k] // 900))
        own = [[] for _ in range(shards)]
        for x in out:
            if x.source == name:
                own[x.hash % shards].append(x)
        stocks = [sum(x.size for x in s) for s in own]
        quota = plain_seats(stocks, blocks[k], [-(-3 * n // 8) for n in stocks])
        for i, (s, stock, q) in enumerate(zip(own, stocks, quota)):
            if not stock:
                continue
            key = (name, i)
            starts[key] = spark.range(1).select(F.xxhash64(F.lit(name).cast("string"), F.lit(i).cast("bigint"), F.lit(mixing.SEED))).first()[0] % -(-stock // 8) * 8
            words = min(q * 8, stock * 3)
            times = [words // stock] * stock
            for w in range(words % stock):
                times[(min(starts[key], stock - 1) + w) % stock] += 1
            at = 0
            for x in sorted(s, key=lambda x: (x.hash, x.doc_id is not None, x.doc_id or 0, x.size)):
                assert x.taken == sum(times[at : at + x.size]), (name, i)
                at += x.size
    assert len(starts) > 8


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randrange(0, 300))), "en", r.choice(["a", "b", "b", "b", None]), 1) for i in range(600)]
    rows += [(600, None, None, "a", None), (601, "one two\x0bthree four", None, "é", 1), (602, " ", None, "zero", 1), (None, "x y", None, "a", 1), (1, "dup", None, "a", 1), (1, "dup", None, "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(df.withColumn("size", F.lit("old")), block=4).collect()
    again = mixing.mixed(df.repartition(7), block=4).collect()
    assert sorted((str(x.doc_id), x.size, x.taken) for x in out) == sorted((str(x.doc_id), x.size, x.taken) for x in again)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({x[3] for x in rows if x[3] is not None}) + [None]
    sums = [sum(size(x[1]) for x in rows if x[3] == n) for n in names]
    want = dict(zip(names, plain_targets(sums, [i % 3 + 1 for i in range(len(names))])))
    for n in names:
        own = [x for x in out if x.source == n]
        assert abs(sum(x.taken for x in own) - want[n]) <= 8 and {(x.source_size, round(x.target, 6)) for x in own} == {(sums[names.index(n)], round(want[n], 6))}
    assert all(x.size == size(x.text) and 0 <= x.taken <= 3 * x.size and sum(t.n for t in x.turns) == x.taken for x in out) and len(out) == len(rows)
    mix = mixing.stage(spark, df, "")
    assert mix.columns == df.columns and mix.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(x.taken for x in mixing.mixed(df).collect())
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.stage(spark, df.limit(0), "").count() == 0


def test_mix_whatever_other_columns_are_called(spark):
    names = ["quota", "stock", "place", "shard", "hash", "doc", "_t", "turns", "size", "weight", "blocks", "a.b"]
    df = spark.createDataFrame([(i, "one two three", "s", *names) for i in range(9)], ["doc_id", "text", "source", *names])
    out = mixing.mixed(df)
    assert out.columns == ["doc_id", "text", "source", *(x for x in names if x not in mixing.RESULTS), *mixing.RESULTS] and out.first().quota == "quota"
    mix = mixing.stage(spark, df, "")
    assert mix.columns == df.columns and mix.count() >= 9 and tuple(mix.first())[3:] == tuple(names)


# 7 ---------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(r, n=250):
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            words = r.choice(rows).split(" ")
            words[r.randrange(len(words))] = "changed"
            rows.append(" ".join(words))
        else:
            rows.append(" ".join(f"w{r.randrange(2000)}" for _ in range(r.choice([1, 3, 4, 30, 200, 400]))))
    return rows


def test_simhash_groups(spark):
    texts = [*near_copies(random.Random(9)), None, "", "  \n", "One TWO", "one two", "É é É é É", "x\x1cy z", "long " * 40_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[5], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    fps = [plain_fingerprint(t[1]) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = union(len(rows), pairs)
    group = {}
    for i, x in enumerate(rows):
        group.setdefault(root[i], []).append(x[0])
    want = sorted((str(x[0]), f"{f:016x}", min(d for d in group[root[i]] if d is not None)) for i, (x, f) in enumerate(zip(rows, fps)))
    path = new_path(spark, "t")
    df.write.parquet(f"{path}/documents.parquet")
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, path).collect()) == want
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(d for d in g if d is not None) for g in group.values())
    assert simhash.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("n, limit", [(10, 16_384), (10**9, 4), (10**12, 16)])
def test_buckets_lose_no_link(spark, n, limit):
    r = random.Random(n)
    fps = set()
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(6):
            x = base
            for b in r.sample(range(64), r.randrange(7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df, edges = spark.createDataFrame([(x,) for x in signed], "fp bigint"), []
    for rows in simhash.buckets(df, n, 4, limit):
        out = rows.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part", "fp").mapInPandas(lambda it: simhash._linked(it, 4), "a bigint, b bigint")
        edges += [(signed.index(e.a), signed.index(e.b)) for e in out.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert union(len(fps), edges) == union(len(fps), want)


# 8 ---------------------------------------------------------------------------


def test_license_scan(spark):
    texts = [
        None, "", "?!", "Licensed under the MIT License.", "under the mit license " * 3, "under the mitt license", "Apache License, Version 2.0", "CC-BY-NC 4.0; cc by nc", "GNU General Public License\nAll rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of that software", "word " * 40_000 + "cc by nc", "é ünder the mit license", "mit", "version 2 license apache", "under the mİt license", "Redistribution and use in source",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[3]])], "doc_id bigint, text string, words string")
    path = new_path(spark, "t")
    df.write.parquet(f"{path}/documents.parquet")
    out = license_scan.op8_license_scan(spark, path).orderBy("doc_id").collect()
    for t, r in zip([*texts, texts[3]], out):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert out[8].labels == "all-rights-reserved,gpl" and out[9].labels == "mit" and 0.8 <= out[9].score < 1 and out[15].labels == "" and out[3].score == 1.0
    df.limit(0).write.parquet(f"{path}/e/documents.parquet")
    assert license_scan.op8_license_scan(spark, f"{path}/e").count() == 0


# 9 ---------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = [(5, "http://é/x y", "abc\r\n\r\nWARC/1.1\r\n"), (3, "http://a", "abc\r\n\r\nWARC/1.1\r\n"), (9, None, None), (7, "u\r\nv", ""), (1, "", "é\0z"), (2, "b", "abc\r\n\r\nWARC/1.1\r\n"), (8, "c", "x" * 300_000), (2, "b", "abc\r\n\r\nWARC/1.1\r\n"), (None, "n", "é\0z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, bytes int")
    path = new_path(spark, "w")
    warc.write_archives(df, path, least)
    got = warc.resolved(warc.read_archives(spark, path, payloads=True)).collect()
    first = {}
    for i, _, h in rows:
        k = (h or "").encode()
        first[k] = min((x for x in (first.get(k), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        k = (h or "").encode()
        revisit = len(k) >= least and i != first[k]
        want.append((str(i), len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "revisit" if revisit else "response", first[k] if revisit else None, k))
    assert sorted((str(r.page_id), r.bytes, r.digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == sorted(want, key=lambda x: x[:1] + x[3:4]) or sorted(map(repr, ((str(r.page_id), r.bytes, r.digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got))) == sorted(map(repr, want))
    assert all(r.stated == r.digest for r in got)
    empty = new_path(spark, "w")
    warc.write_archives(df.limit(0), empty)
    assert warc.resolved(warc.read_archives(spark, empty)).count() == 0


# 10 --------------------------------------------------------------------------

PATTERNS = {"assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 12), "access": ("AKIA[A-Z0-9]+", 0, 0, 18), "hex": ("[0-9a-f]+", 0, 0, 16)}


def test_secret_scan(spark):
    r = random.Random(11)
    parts = ["token = ", "API_key:", "'", '"', "secret=", "AKIA", "abcdefABCDEF0123456789", "0123456789abcdef", "é", " ", "\n", "password: token: abcdefghijklmn", "AKIAAKIA" + "Z" * 14, "😀", "=", "x.y/z+"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(300)] + [None, "", "deadbeefdeadbeef " * 3000]
    linked = "client_id = abcd Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1 https://h.example/x"
    texts += [linked, "Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1 alone", "client_id = abcd alone", "https://h.example/x alone", "client_id = abcd" + " far" * 100 + " Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1", linked]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "token=abcdefghijklmnop", "c")], "doc_id bigint, text string, spans string")
    path = new_path(spark, "t")
    df.write.parquet(f"{path}/documents.parquet")
    got = {x.doc_id: x for x in secret_scan.op10_secret_scan(spark, path).collect()}
    assert len(got) == len(texts) + 1 and got[None].spans == "assign:0:22"
    for i, t in enumerate(texts):
        spans = [(m.start(), n, m.end(), k) for n, (k, (p, f, g, least)) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "", f) if len(m[g]) >= least]
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        x = got[i]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(s[1] == n for s in spans) for n in range(3)), t
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(x.spans.split(","))
    n = len(texts)
    assert got[n - 6].spans == got[n - 1].spans == "id:0:16,opaque:17:53,endpoint:54:73" and all(got[n - k].spans == "" for k in (5, 4, 3, 2))
    df.limit(0).write.parquet(f"{path}/e/documents.parquet")
    assert secret_scan.op10_secret_scan(spark, f"{path}/e").count() == 0


def test_native_plans_have_no_python(spark):
    df = spark.createDataFrame([(1, "under the mit license token=abcdefghijklmnop")], "doc_id bigint, text string")
    path = new_path(spark, "t")
    df.write.parquet(f"{path}/documents.parquet")
    for query in (license_scan.op8_license_scan, secret_scan.op10_secret_scan):
        plan = query(spark, path)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Pipeline --------------------------------------------------------------------


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    r = random.Random(12)
    item = " ".join(f"b{r.randrange(300)}" for _ in range(20))
    rows = []
    for i in range(150):
        lang = r.choice(("aa", "bb"))
        text = " ".join(r.choice(WORDS[lang]) + (str() if r.random() < 0.9 else r.choice("xyz")) for _ in range(r.randrange(20, 80)))
        rows.append((i, text, lang, r.choice(["s0", "s0", "s1", None]), len(text)))
    rows += [(200, rows[0][1], "aa", "s1", 1), (201, f"{rows[1][1]} {item}", "bb", "s0", 1), (202, None, None, "s0", None), (203, "123", "aa", "s1", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    path = new_path(spark, "p")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        out.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        seen.append(now)
    one, two, three, four, five = seen
    assert all(x.columns == docs.columns for x in seen[:4])
    assert {x.doc_id for x in one.collect()} == {x[0] for x in rows} - {202, 203}
    kept = {x.doc_id for x in two.collect()}
    assert 0 in kept and 200 not in kept
    assert {x.doc_id for x in three.collect()} == kept - {201}
    words = sum(len(x.text.split()) for x in three.collect())
    assert abs(sum(len(x.text.split()) for x in four.collect()) - words) <= mixing.BLOCK_WORDS
    assert sum(x.n_tokens for x in five.collect()) == sum(len(packing.tokens(x.text, packing.byte_bpe(f"{packing.TOKENIZERS}/{packing.VOCABULARY}"))) for x in four.collect())
    assert corpus_pipeline.run(spark, path).count() == five.count()


