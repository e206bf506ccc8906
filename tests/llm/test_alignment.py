"""Alignment against brute force over bytes, for blocks and heads of any size, and all cases of tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanview.llm import alignment as al
from spanview.llm.common import written
from spanview.llm.tokens import TOKENIZERS, byte_bpe


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{TOKENIZERS}/{al.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{al.B_FILE}")


def brute(libraries, docs):
    """Rows by comparing every token's bytes with every other's."""
    a, b = libraries
    known, seen, counts = byte_bpe(f"{TOKENIZERS}/{al.A_FILE}").bytes_of, [], Counter()
    for doc_id, text in docs:
        ids_a = ids_b = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            of_a = [known[i] for i in ids_a]
            of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
                ids_a = ids_b = []
        if not ids_a:
            seen.append((doc_id, [], [], 0, [], ""))
            continue
        spans = []
        for parts in (of_a, of_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for end in common:
            sides = [",".join(str(i) for i, (s, e) in zip(ids, where) if before < e <= end) for ids, where in zip((ids_a, ids_b), spans)]
            groups.append("|".join(sides))
            before = end
        links = [(i, j) for i, (s, e) in zip(ids_a, spans[0]) for j, (t, f) in zip(ids_b, spans[1]) if s < f and t < e]
        counts.update(set(links))
        seen.append((doc_id, ids_a, ids_b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    return [(d, len(x), len(y), g, len(k), sum(counts[p] == top[p[0]] for p in k), sum(counts[p] for p in k), h) for d, x, y, g, k, h in seen]


def documents():
    r = random.Random(6)
    parts = ["the ", "ing", " naïve", "語言", "😀👍🏽", " 1234", "  ", "\n\n", "\t", "don't", "<|endoftext|>", "<s>", "<0x0A>", "aaaaaaa", "==", ".", "ſ", "é", "\x00", " "]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " "), (503, "▁ is not a space"), (504, "same text"), (504, "same text"), (None, "no id"), (505, " " * 300 + "x" * 301), (506, "word " * 300), (507, "ﬁ ½ ①")]
    return docs


@pytest.mark.parametrize("block,head", [(8192, 400_000), (3, 0), (17, 40)])
def test_as_by_brute_force(spark, libraries, block, head, monkeypatch):
    docs = documents()
    df = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, row string, n int").repartition(3)
    swept = written(al.aligned(al.encoded(df, block=block)), "test")
    got = [tuple(x) for x in al.counted(swept, 32_000, head).collect()]
    want = brute(libraries, docs)
    assert Counter(got) == Counter(want)
    assert sum(x[1] for x in want) > 1000 and (503, 0, 0, 0, 0, 0, 0, "") in want


@pytest.mark.parametrize("block", [1, 5, 64])
def test_blocks_of_a_sweep_change_nothing(libraries, block, monkeypatch):
    """A document in many blocks, advanced at every one, gives what it gives at once."""
    monkeypatch.setattr(al, "BLOCK", 2)
    text = " ".join(x for _, x in documents() if x)[:4000].replace("▁", "")
    a, b = byte_bpe(f"{TOKENIZERS}/{al.A_FILE}"), al.piece_bpe(f"{TOKENIZERS}/{al.B_FILE}")
    ids = a.encode(" " + text).astype(np.int64), b.encode(text).astype(np.int64)
    assert b.decoded(ids[1]) == b" " + text.encode()
    names = tuple(np.array([f"{i}{e}" for i in range(n)], dtype=object) for n, ends in ((len(a.lengths), ",|"), (len(b.lengths), ",;")) for e in ends)
    results = []
    for step in (block, 10**9):
        events = sorted((int((a, b)[s].lengths[ids[s][:i]].sum()), s, i) for s in (0, 1) for i in range(0, len(ids[s]), step))
        sweep = al.Sweep((a.lengths, b.lengths), names)
        for at, s, i in events:
            sweep.take(s, at, ids[s][i : i + step])
        sweep.advance()
        pairs, times = sweep.distinct()
        results.append((sweep.n, sweep.groups, sweep.links, sweep.hash.hexdigest(), pairs.tolist(), times.tolist()))
    assert results[0] == results[1]


def test_stretches_of_pieces(monkeypatch):
    known, r = al.piece_bpe(f"{TOKENIZERS}/{al.B_FILE}"), random.Random(8)
    whole = [("".join(r.choice(["ab", " ", "  ", "é ", "\n", "word", " x", "語"]) for _ in range(r.randrange(1, 90)))) for _ in range(300)]
    want = [known.encode(x).tolist() for x in whole]
    monkeypatch.setattr(al, "STRETCH", 7)
    assert [known.encode(x).tolist() for x in whole] == want


def test_long_and_hot_documents(spark):
    docs = spark.createDataFrame([(1, "a" * 3_000_000), (2, " " * 1_000_000 + "b"), (3, "many words " * 100_000)] + [(10 + i, "a hot copy") for i in range(2000)], "doc_id long, text string")
    out = {x.doc_id: x for x in al.counted(written(al.aligned(al.encoded(docs)), "test"), 32_000).collect()}
    assert len(out) == 2003 and out[10].count_sum >= 2000 * out[10].n_links and out[3].n_links >= 200_000
    assert all(out[i].n_groups > 0 and len(out[i].groups_sha256) == 64 for i in (1, 2, 3))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = al.counted(written(al.aligned(al.encoded(docs)), "test"), 32_000)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 0


def test_query_over_the_smallest_tables(spark, libraries):
    base = "/root/testdata/sf0.001"
    docs = [tuple(x) for x in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    short = [x for x in docs if len(x[1] or "") < 1500]
    got = al.op13_alignment(spark, base).collect()
    assert len(got) == len(docs)
    by_id = {x.doc_id: x for x in got}
    # Counts are of the whole corpus; what does not depend on them is compared for the documents that brute force can do.
    for d, n_a, n_b, groups, links, _, _, digest in brute(libraries, short):
        assert (by_id[d].n_a, by_id[d].n_b, by_id[d].n_groups, by_id[d].n_links, by_id[d].groups_sha256) == (n_a, n_b, groups, links, digest)
