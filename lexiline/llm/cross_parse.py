"""Language identification by cross-parsing entropy.

Texts become symbols: lower-cased letters of the alphabet of the training passages (its `ALPHABET` most frequent letters, one symbol
for all others) and one gap for each run of anything else, with a gap ahead of the text. For each language a suffix automaton
holds the training passages, parted by a symbol that no text has. A text is parsed against each automaton into phrases: each is the
longest match of what lies ahead with any place of the language's passages, or one symbol where nothing matches. A phrase
costs the logarithm of the number of training symbols, as it could point to any of them; the language with the least cost a symbol wins.
All pieces of `PIECE` symbols of a batch of texts and all languages walk through the automata in step; a phrase ends with its
piece, and the phrases of all pieces of a text add up.

Learning reads text and lang of rows whose `crc32(doc_id) mod 3` is not 1, and takes a bounded sample (a documented bound of the fit;
prediction has none): for each of the `LANGUAGES` most frequent languages the `PASSAGES` texts with the smallest hashes, and of each
one passage of `PASSAGE` characters, anywhere in the text as its hash tells. Equal texts count once. As labels may be wrong and
texts mixed, a passage goes if the automata of the other half of the passages find another language in it (unless its language would lose all).
Language, source and id are no inputs of a prediction.

Cases: a text that is null or has no letter is `und` with score 0, and so is every text where no labelled row can be learned from;
a null id counts as not held out; ties go to the language that comes first by name. The score is the share by which the best language
undercuts the next one (1 if there is only one). Repeated ids are rows of their own; an empty table gives an empty
result; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiline.llm.common import small_batches

PASSAGES = 96
PASSAGE = 512
LANGUAGES = 64
ALPHABET = 60
PIECE = 1024
#: Characters of texts that are parsed together.
TOGETHER = 1_000_000
UNKNOWN = "und"
GAP, RARE = 0, 1


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_passages(docs: DataFrame, passages: int = PASSAGES, width: int = PASSAGE, languages: int = LANGUAGES) -> dict[str, tuple[str, ...]]:
    """Passages by language, the same for any layout of the table."""
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    names = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages)
    known = sorted(r["lang"] for r in names.collect())
    if not known:
        return {}
    digest = F.xxhash64("text")
    parts = F.greatest(F.ceil(F.length("text") / F.lit(width)), F.lit(1))
    start = F.pmod(digest, parts) * width + 1
    drawn = labelled.filter(F.col("lang").isin(known)).select("lang", digest.alias("digest"), F.col("text").substr(start.cast("int"), F.lit(width)).alias("passage"))
    # A rank within the bound is cut ahead of the shuffle, so that a frequent language sends no more than others.
    ranked = drawn.withColumn("n", F.dense_rank().over(Window.partitionBy("lang").orderBy("digest"))).filter(F.col("n") <= passages)
    rows = ranked.groupBy("lang", "digest").agg(F.min("passage").alias("passage")).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["digest"])):
        out.setdefault(r["lang"], []).append(r["passage"])
    return {lang: tuple(found) for lang, found in out.items()}


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each behind a gap, and where each text starts."""
    lowered = ["\n" + t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) for t in lowered)])[:-1]
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4"), starts


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a sequence, state by state; state 0 is the root."""
    ahead: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(ahead)
        ahead.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in ahead[at]:
            ahead[at][c] = new
            at = link[at]
        if at >= 0:
            to = ahead[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(ahead)
                ahead.append(dict(ahead[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = twin
                while at >= 0 and ahead[at].get(c) == to:
                    ahead[at][c] = twin
                    at = link[at]
        last = new
    return ahead


class Parser:
    """Automata of all languages in one table of transitions."""

    def __init__(self, passages: tuple[tuple[str, tuple[str, ...]], ...]):
        self.languages = [lang for lang, _ in passages]
        counts: Counter = Counter()
        for _, found in passages:
            codes, _ = codes_of(list(found))
            counts.update(codes[letters()[codes]].tolist())
        kept = sorted(counts, key=lambda c: (-counts[c], c))[:ALPHABET]
        self.table = letters().astype(np.uint8) * RARE
        self.table[kept] = np.arange(2, 2 + len(kept), dtype=np.uint8)
        self.end = 2 + len(kept)
        width = self.end + 1
        parts, roots, costs = [], [], []
        offset = 0
        for _, found in passages:
            symbols, starts = self.symbols_of(list(found))
            joined: list[int] = []
            for text in np.split(symbols, starts[1:]):
                joined += [*text.tolist(), self.end]
            states = automaton(joined)
            dense = np.full((len(states), width), -1, dtype=np.int32)
            for i, ahead in enumerate(states):
                for c, to in ahead.items():
                    dense[i, c] = offset + to * width
            dense[0, dense[0] < 0] = offset  # at the root an unknown symbol is a phrase of its own
            dense[:, self.end] = -1
            parts.append(dense.ravel())
            roots.append(offset)
            costs.append(np.log2(len(joined) + 1))
            offset += dense.size
        if offset >= 1 << 31:
            raise ValueError("too many training passages")
        self.ahead = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.roots, self.costs = np.array(roots, dtype=np.int32), np.array(costs)

    def symbols_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts, one after the other, and where each text starts; a run of other characters is one gap."""
        codes, starts = codes_of(texts)
        out = self.table[codes]
        keep = out != GAP
        keep[1:] |= out[:-1] != GAP
        keep[starts] = True
        return out[keep], np.cumsum(np.r_[0, np.add.reduceat(keep.astype(np.int64), starts)])[:-1]

    def phrases(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Number of phrases: (texts, languages)."""
        sizes = np.diff(np.r_[starts, len(symbols)])
        pieces = -(-sizes // PIECE)
        text_of = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = starts[text_of] + nth * PIECE
        lengths = np.minimum(PIECE, sizes[text_of] - nth * PIECE)
        # a mark ends each piece
        laid = np.full(len(symbols) + len(first), self.end, dtype=np.uint8)
        laid[np.arange(len(symbols)) + np.repeat(np.arange(len(first)), lengths)] = symbols
        n = len(self.roots)
        lane = np.arange(len(first) * n)
        at = np.repeat(first + np.arange(len(first)), n)
        root = np.tile(self.roots, len(first))
        state, count = root.copy(), np.zeros(len(lane), dtype=np.int32)
        out = np.zeros(len(starts) * n, dtype=np.int64)
        slot = np.repeat(text_of, n) * n + np.tile(np.arange(n), len(first))
        while len(lane):
            for _ in range(64):
                to = self.ahead[state + laid[at]]
                on = to >= 0
                count += on & (state == root)
                at += on
                state = np.where(on, to, root)
            over = laid[at] == self.end
            if over.any():
                np.add.at(out, slot[lane[over]], count[over])
                left = ~over
                lane, at, root, state, count = lane[left], at[left], root[left], state[left], count[left]
        return out.reshape(-1, n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score."""
        best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return best, score
        todo = [i for i, t in enumerate(texts) if t]
        while todo:
            group, size = [], 0
            while todo and (not group or size + len(texts[todo[-1]]) <= TOGETHER):
                group.append(todo.pop())
                size += len(texts[group[-1]])
            symbols, starts = self.symbols_of([texts[i] for i in group])
            sizes = np.diff(np.r_[starts, len(symbols)])
            told = np.add.reduceat((symbols != GAP).astype(np.int64), starts) > 0
            bits = self.phrases(symbols, starts) * self.costs / sizes[:, None]
            order = np.argsort(bits, axis=1, kind="stable")
            low = np.take_along_axis(bits, order[:, :2], 1)
            for i, win, gain, ok in zip(group, order[:, 0], 1 - low[:, 0] / low[:, 1] if bits.shape[1] > 1 else np.ones(len(bits)), told, strict=True):
                if ok:
                    best[i], score[i] = self.languages[win], gain
        return best, score


@lru_cache(maxsize=2)
def parser(passages: tuple[tuple[str, tuple[str, ...]], ...]) -> Parser:
    """Built once in each Python worker."""
    return Parser(passages)


def cleaned(passages: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The passages without those that look like another language to the other half of them; at most the sample's size."""
    halves = [{lang: found[k::2] for lang, found in passages.items() if found[k::2]} for k in (0, 1)]
    out: dict[str, tuple[str, ...]] = {lang: () for lang in passages}
    for mine, other in (halves, halves[::-1]):
        judge = Parser(tuple(sorted(other.items())))
        for lang, found in mine.items():
            told, _ = judge.predict(list(found))
            out[lang] += tuple(p for p, t in zip(found, told, strict=True) if t == lang or lang not in other)
    return {lang: found or passages[lang] for lang, found in out.items()}


def identify(docs: DataFrame, passages: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text."""
    model = tuple(sorted(cleaned(passages).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = parser(model)
        for b in batches:
            best, score = built.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    small_batches(docs.sparkSession, 1000)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
