"""The pipeline on empty tables, and on rows with nulls, repeats, very long runs and clashing columns."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from spanview.llm import packing  # noqa: E402
from spanview.llm.tokens import TOKENIZERS, byte_bpe  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def put(spark, path, docs, columns=DOCS):
    spark.createDataFrame(docs, columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "a question that no document of this test holds in whole or in any part of it at all")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, put(spark, tmp_path / "empty", []))
    assert out.count() == 0 and "segments" in out.columns


def test_odd_rows(spark, tmp_path):
    words = {"aa": "kala muna rotu seli vado nemi".split(), "bb": "strick grumpf knolz bratz wunz fropp".split()}
    r = np.random.default_rng(3)
    text = lambda lang, n: " ".join(r.choice(words[lang], n))
    docs = [(i, text(lang, 60 + i), lang, f"s{i % 3}", 1, "clash", 1) for i in range(40) for lang in [("aa", "bb")[i % 2]]]
    docs += [(100, None, "aa", "s0", 0, None, None), (101, "", "aa", None, 0, "x", 1), (102, docs[0][1], "aa", "s0", 1, "x", 1), (102, docs[0][1], "aa", "s0", 1, "x", 1)]
    docs += [(103, text("aa", 50) + " " * 1_000_000 + text("aa", 50), "aa", "s1", 1, "x", 1), (None, text("bb", 90), "bb", "s2", 1, "x", 1)]
    path = put(spark, tmp_path / "odd", docs, DOCS + ", fp string, ids int")
    rows = corpus_pipeline.run(spark, path).collect()
    known, parts = byte_bpe(f"{TOKENIZERS}/{packing.VOCABULARY}"), {}
    for x in rows:
        ids = np.frombuffer(x.ids, dtype="<u2")
        for at, s in zip(x.cu_seqlens, x.segments):
            parts.setdefault(s.doc_id, []).append(known.encoding.decode(ids[at : at + s.n][ids[at : at + s.n] != packing.END].tolist()))
    held = {i for i in parts}
    # Null and empty texts have no language; of equal texts one document stays.
    assert not held & {100, 101} and not {0, 102} <= held and 103 in held and len(held) > 30
    assert " " * 900_000 in "".join(parts[103])
