"""Long texts get the ids of the uncut call, and no run of one character ends the process."""

import random

import numpy as np
import pytest

from spanview.llm import packing, tokens

JSON, RANKS = f"{tokens.TOKENIZERS}/byte_bpe_50k.json", f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture
def short(monkeypatch):
    """Stretches of 40 characters and runs of 5."""
    import re

    monkeypatch.setattr(tokens, "STRETCH", 40)
    monkeypatch.setattr(tokens, "_RUN", re.compile(f"[{tokens.SPACE}]{{5,}}"))


def test_cut_texts_have_the_ids_of_the_uncut_call(short):
    from tokenizers import Tokenizer

    known, library = tokens.byte_bpe(JSON), Tokenizer.from_file(JSON)
    r = random.Random(1)
    spaces = [" ", "  ", "\t", "\n", "\r\n", " ", "\u0085", " ", "　", "\x1c", "\x1f", " " * 7, "\t" * 9, "\n \n" * 4, "​"]
    parts = ["it's", "we'll", "naïve", "語言", "😀👍🏽", "42", "1,000", "##", "'", "'re", "a" * 30, "x" * 90, "=" * 50, "<|endoftext|>", "٣٤", "é"]
    for _ in range(400):
        text = "".join(r.choice(parts if r.random() < 0.5 else spaces) for _ in range(r.randrange(60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert known.encode(text, special=True).tolist() == want
        plain = known.encode(text).tolist()
        assert plain == known.encoding.encode_ordinary(text)
        assert known.lengths[plain].sum() == len(text.encode())


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "　", "a", "語", "7", "="])
def test_ids_at_a_hundred_thousand(unit):
    known = tokens.byte_bpe(RANKS)
    for text in (unit * 100_000, "go" + unit * 100_000 + "on", "go " + unit * 100_000 + " "):
        assert known.encode(text).tolist() == known.encoding.encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "\t", "a", "7", "="])
def test_ten_million_of_a_character(unit):
    known = tokens.byte_bpe(RANKS)
    ids = known.encode("go " + unit * 10_000_000 + "x")
    assert known.lengths[ids.astype(np.int64)].sum() == 10_000_004


def test_long_runs_are_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, "\t" * 1_000_000), (3, "y")], "doc_id long, text string")
    known, parts = tokens.byte_bpe(RANKS), {}
    for x in packing.packed(docs).collect():
        ids = np.frombuffer(x.ids, dtype="<u2")
        for at, s in zip(x.cu_seqlens, x.segments):
            parts.setdefault(s.doc_id, []).append((s["first"], ids[at : at + s.n].tolist()))
    back = {i: known.encoding.decode([t for _, p in sorted(x) for t in p][:-1]) for i, x in parts.items()}
    assert back == {1: " " * 1_000_000 + "x", 2: "\t" * 1_000_000, 3: "y"}
