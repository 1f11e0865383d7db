"""Toxicity scores by a factorization machine over hashed terms.

A term is a word or one of its prefixes (`PREFIXES` letters), so that inflected forms share evidence. Terms
are hashed; the value of a term is `log(1 + count) / log(2)`, damped by the length of the text. The machine adds a
weight per term and, for every pair of terms, the inner product of two latent vectors, so that two terms can
mean more together than their sum.

Learning reads labelled rows only: rows whose `crc32(doc_id) mod 5` is not 0, at most `TRAIN_ROWS` of them,
taken in the order of a hash of the id (a documented bound of the fit; scoring has none). The `TERMS` hashed
terms with the highest chi-square form the vocabulary. Labels, language, source and id are no inputs of a
score.

Cases: null and empty texts score like a text without known terms; label rows that are null or that name no
document are ignored, several labels of one document count as the largest; a document that occurs several
times is scored each time; without any labelled row every score is 0. Extra columns of the documents are
kept by `reject` and ignored by `score`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiline import session
from lexiline.llm.common import small_batches

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7)
BUCKETS = 1 << 20
TRAIN_ROWS = 16_000
TERMS = 2_048
FACTORS = 8
EPOCHS = 12
MEMO = 200_000


def terms_of(word: str) -> list[int]:
    """Hashed terms of one word: the word itself and its prefixes."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    out += [zlib.crc32(f"{word[:n]}~".encode()) % BUCKETS for n in PREFIXES if len(word) > n]
    return out


def counts_of(text: str | None, lookup: dict[str, list[int]], known: dict[int, int] | None) -> tuple[Counter, int]:
    """Counts of the terms of a whole text (of the known ones, by their index) and its number of words.

    `lookup` remembers the terms of words between texts; it is emptied when it grows large.
    """
    words = Counter(WORD.findall((text or "").lower()))
    out: Counter = Counter()
    for word, n in words.items():
        found = lookup.get(word)
        if found is None:
            if len(lookup) >= MEMO:
                lookup.clear()
            found = terms_of(word)
            if known is not None:
                found = [known[t] for t in found if t in known]
            lookup[word] = found
        for t in found:
            out[t] += n
    return out, sum(words.values())


def value(count: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Value of a term that occurs `count` times in a text of `length` words."""
    return np.log2(1.0 + count) / np.log2(2.0 + np.maximum(length, 30) / 30.0)


class Machine:
    """Weights of a trained machine; `index` maps a hashed term to its row."""

    def __init__(self, index: dict[int, int], factors: int = FACTORS, seed: int = 7):
        self.index = index
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(len(index))
        self.v = rng.normal(0, 0.02, (len(index), factors))

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s**2).sum(1) - (x**2) @ (self.v**2).sum(1)), s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4) -> Machine:
        """Adagrad on the logistic loss, in a fixed order of small batches."""
        if not len(rows):
            return self
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.bias = math.log(share / (1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                x = dense([rows[i] for i in pick], len(self.index))
                raw, s = self.raw(x)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
                dw = x.T @ g + decay * self.w
                dv = x.T @ (g[:, None] * s) - ((x**2).T @ g)[:, None] * self.v + decay * self.v
                db = float(g.sum())
                gw += dw**2
                gv += dv**2
                gb += db**2
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= 0.2 * rate * dv / np.sqrt(gv)
                self.bias -= rate * db / math.sqrt(gb)
        return self

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty(len(rows))
        for at in range(0, len(rows), 512):
            x = dense(rows[at : at + 512], len(self.index))
            raw = self.raw(x)[0] if len(self.index) else np.full(len(x), self.bias)
            out[at : at + 512] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return out

    def of_texts(self, texts, lookup: dict[str, list[int]]) -> np.ndarray:
        rows = []
        for text in texts:
            counts, length = counts_of(text, lookup, self.index)
            rows.append((np.fromiter(counts.keys(), np.int64, len(counts)), value(np.fromiter(counts.values(), float, len(counts)), length)))
        return self.scores(rows)


def dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for i, (cols, vals) in enumerate(rows):
        x[i, cols] = vals
    return x


def held_out(doc_id):
    """Rows that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, label, text) of at most `limit` labelled rows, the same for any layout of the tables."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # At most `limit` rows of two numbers, whatever the input: the one side here whose size is proven.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, terms: int = TERMS) -> Machine:
    """Choose the terms by chi-square on the training rows, then fit the machine on them."""
    small_batches(docs.sparkSession, 500)
    rows = training_rows(docs, labels, limit)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup: dict[str, list[int]] = {}
        for b in batches:
            found = [counts_of(t, lookup, None) for t in b["text"]]
            yield pd.DataFrame(
                {"label": b["label"], "length": [n for _, n in found], "terms": [list(c.keys()) for c, _ in found], "counts": [list(c.values()) for c, _ in found]}
            )

    counted = rows.mapInPandas(count, "label int, length long, terms array<int>, counts array<int>")
    counted = session.cut_lineage(counted)
    total = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, pos = int(total["n"]), int(total["pos"])
    if not pos or pos == n:
        return constant(1.0 if pos else 0.0)
    a = F.col("hits")
    b = F.col("seen") - F.col("hits")
    chi = F.pow(a * F.lit(float(n - pos)) - b * F.lit(float(pos)), F.lit(2.0)) / (F.col("seen") * (F.lit(float(n)) - F.col("seen") + 0.5))
    top = (
        counted.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").cast("double").alias("seen"), F.sum("label").cast("double").alias("hits"))
        .filter("seen >= 3")
        .orderBy(chi.desc(), "term")
        .limit(terms)
    )
    index = {t: i for i, t in enumerate(sorted(r["term"] for r in top.collect()))}
    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols, vals = [], []
            for t, c in zip(b["terms"], b["counts"], strict=True):
                pairs = [(index[x], y) for x, y in zip(t, c, strict=True) if x in index]
                cols.append([p[0] for p in pairs])
                vals.append([p[1] for p in pairs])
            yield pd.DataFrame({"label": b["label"], "length": b["length"], "terms": cols, "counts": vals})

    local = counted.mapInPandas(shrink, "label int, length long, terms array<int>, counts array<int>").toPandas()
    order = sorted(range(len(local)), key=lambda i: (len(local["terms"][i]), int(local["length"][i]), sorted(local["terms"][i])))
    local = local.iloc[order]
    data = [
        (np.asarray(t, dtype=np.int64), value(np.asarray(c, dtype=float), m))
        for t, c, m in zip(local["terms"], local["counts"], local["length"], strict=True)
    ]
    return Machine(index).fit(data, local["label"].to_numpy(dtype=float))


def constant(score: float) -> Machine:
    out = Machine({})
    out.bias = 30.0 if score >= 0.5 else -50.0
    return out


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup: dict[str, list[int]] = {}
        for b in batches:
            yield b.drop(columns="text").assign(score=machine.of_texts(b["text"], lookup))

    small_batches(docs.sparkSession, 500)
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = source.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that are not predicted toxic, in all their columns; rows without a text stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: dict[str, list[int]] = {}
        for b in batches:
            yield b.filter(pa.array(machine.of_texts(b.column("text").to_pylist(), lookup) < 0.5))

    small_batches(docs.sparkSession, 500)
    return docs.mapInArrow(run, docs.schema)
