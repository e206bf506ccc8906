"""Token ids by public byte-level vocabularies, for texts of any length.

The vocabulary splits a text by a pattern before it merges. A library's pattern matcher goes deeper with each character of a
run of white space, and one of some hundred thousand ends the process; ids as a Python list take tens of bytes each. So long
texts are cut where the pattern splits anyway:

* between a character that is not white space and white space, where every token ends;
* before the last character of a run of white space that something follows (all before it is one token by the pattern), and
  at the end of a run that ends the text. Such a run is merged as it is, without the pattern.

Ids are those of the uncut text.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import tiktoken

TOKENIZERS = "/opt/tokenizers"
#: How the vocabulary's authors split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern takes for white space (Unicode's property, which differs from Python's \s).
SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts up to this many characters are encoded in one call, longer ones in stretches of about this many; a longer run of white space is on its own.
STRETCH, RUN = 65_536, 4_096

_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")
_BREAK = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes of each token, special tokens) of a vocabulary file: ranks by line, or JSON with merges."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte_of, special = _byte_of(), {x["content"]: x["id"] for x in file["added_tokens"]}
    vocabulary = file["model"]["vocab"]
    for i, merge in enumerate(file["model"]["merges"]):
        if vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))] != 256 + i:
            raise ValueError("ids are not in the order of merges")
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}, special


class ByteBPE:
    """A vocabulary. lengths has the number of bytes of each id, special the strings that encode(..., special=True) takes for tokens."""

    def __init__(self, path: str):
        known, self.special = ranks(path)
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.lengths = np.zeros(max(known.values()) + 1, dtype=np.int64)
        self.bytes_of = {i: token for token, i in known.items()}
        for token, i in known.items():
            self.lengths[i] = len(token)
        self._split = re.compile("|".join(re.escape(x) for x in self.special)) if self.special else None

    def encode(self, text: str, special: bool = False) -> np.ndarray:
        """Ids (uint16) of the whole text; the strings of special tokens are plain text unless special is set."""
        if special and self._split and (found := list(self._split.finditer(text))):
            out, at = [], 0
            for x in found:
                out += [self.encode(text[at : x.start()]), np.array([self.special[x[0]]], dtype="<u2")]
                at = x.end()
            return np.concatenate([*out, self.encode(text[at:])])
        if len(text) <= STRETCH // 2:
            return np.array(self.encoding.encode_ordinary(text), dtype="<u2")
        out, at = [], 0
        for run in _RUN.finditer(text):
            out += self._stretches(text, at, run.start())
            at = run.end() - (run.end() < len(text))
            out.append(np.array(self.encoding._core_bpe.encode_single_piece(text[run.start() : at].encode()), dtype="<u2"))
        return np.concatenate([*out, *self._stretches(text, at, len(text))])

    def _stretches(self, text: str, at: int, end: int) -> list[np.ndarray]:
        out = []
        while at < end:
            found = _BREAK.search(text, at + STRETCH, end) if end - at > STRETCH else None
            to = found.start() if found else end
            out.append(np.array(self.encoding.encode_ordinary(text[at:to]), dtype="<u2"))
            at = to
        return out


_known: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    """The vocabulary of a file, read once a process."""
    if path not in _known:
        _known[path] = ByteBPE(path)
    return _known[path]
