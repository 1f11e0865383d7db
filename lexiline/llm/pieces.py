"""Byte-pair encoding of whole texts piece by piece, with ids equal to the tokenizers library's on the whole text.

A text is cut before a space that follows a non-space (`encode`), and for `cut` also around plain punctuation and line
ends next to Latin letters. Both public vocabularies end a word there, no normalisation step reaches over such a place and no special
token is split, so pieces can be encoded on their own. Pieces recur in a task; the library encodes each of
them once while the memo holds it.

Ids are kept as packed little-endian integers, two bytes each where the vocabulary allows it.
"""

from __future__ import annotations

import os
import re

import numpy as np

LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PIECE = re.compile(rf" ?[{LATIN}]+(?=[ ,.;:!?\n]|\Z)|[,.;:!?]+(?=[ \n]|\Z)|\n(?=[{LATIN}])| ?[^ ]+")
ODD = re.compile(r"\s |\s\Z")
CUT = re.compile(r"(?<=\S)(?= )")
WORD = re.compile(rf" ?[{LATIN}]+\Z")
MEMO = 1_000_000  # words that a worker remembers for `encode`, about 200 bytes each
PARTS = 300_000  # pieces that it remembers for `learn`
TOGETHER = 4000  # new pieces that are encoded as one text
LONG = 80  # longer pieces are not remembered


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def cut(text: str) -> list[str]:
    """Pieces whose encodings, joined, are the encoding of the text."""
    if ODD.search(text):
        return CUT.split(text)
    return PIECE.findall(text)


class Encoder:
    """A tokenizer with a memo of pieces."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.memo: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        # Tokens that begin (after a space) or end a word, by the marks of the two kinds of vocabularies.
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.edge = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.edge[i] = token.endswith(self.suffix) if self.suffix else token.startswith("\u0120")

    def raw(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text as the library gives them."""
        if not texts:
            return []
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Packed ids of many words, each after a space: encoded as one text and parted at the marks of words.

        Where the marks do not give one part per word, the words are encoded one by one.
        """
        out = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            packed = self.raw([" " + " ".join(part)])[0]
            edges = np.flatnonzero(self.edge[self.unpack(packed)]) * np.dtype(self.dtype).itemsize
            if self.suffix:
                ends = (edges + np.dtype(self.dtype).itemsize).tolist()
                bounds = [0, *ends]
            else:
                bounds = [*edges.tolist(), len(packed)]
            if len(bounds) != len(part) + 1 or bounds[0] != 0 or bounds[-1] != len(packed):
                out += self.raw([f" {w}" for w in part])
            else:
                out += [packed[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def unpack(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, dtype=self.dtype)

    def learn(self, pieces: list[list[str]]) -> dict[str, bytes]:
        """Packed ids of all pieces of a few texts; long pieces are known for this call only."""
        memo = self.memo
        new = list(set().union(*pieces).difference(memo)) if pieces else []
        if not new:
            return memo
        if len(memo) > PARTS:
            memo.clear()
            new = list(set().union(*pieces))
        plain = [p for p in new if p[0] == " " and len(p) <= LONG and WORD.match(p)]
        rest = list(set(new).difference(plain))
        found = dict(zip(rest, self.raw(rest), strict=True))
        memo.update(zip(plain, self.together([p[1:] for p in plain]), strict=True))
        memo.update((p, i) for p, i in found.items() if len(p) <= LONG)
        return memo if all(len(p) <= LONG for p in rest) else {**memo, **found}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each whole text."""
        odd = [i for i, t in enumerate(texts) if ODD.search(t)]
        out = dict(zip(odd, self.raw([texts[i] for i in odd]), strict=True))
        first, words, sizes = [], [], []
        for i, t in enumerate(texts):
            if i not in out:
                parts = t.split(" ")
                first.append(parts[0])
                words += parts
                sizes.append(len(parts))
        known = self.spaced
        if len(known) > MEMO:
            known.clear()
        new = list(set(words).difference(known))
        known.update(zip(new, self.together(new), strict=True))
        found = list(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONG:
                del known[w]
        heads, at, k = self.raw(first), 0, 0
        for i in range(len(texts)):
            if i not in out:
                out[i] = heads[k] + b"".join(found[at + 1 : at + sizes[k]])
                at += sizes[k]
                k += 1
        return [out[i] for i in range(len(texts))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
