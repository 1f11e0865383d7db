"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both sides.

Words are the `VOCABULARY` tokens of the network: the most frequent words of all documents, and hash buckets for the
rest. The network embeds `SIDE` words on each side, has one hidden layer and a softmax tree of three levels with 16
branches each, so that a prediction costs 48 outputs. It starts from the word counts of the corpus and is
trained in numpy on all documents, each used once: in every round the tasks take their share of the round's documents
from the same weights, and their weights are averaged by the words they saw. Sums of conditional log-probabilities
score the documents.

A bucket is a class of words: the network gives the chance of the bucket, and the stored counts the chance of the word in
it, count / (words of the bucket + 1), so that every word of the corpus has a probability of its own. The counts of the `SHARED` most
frequent bucketed words go along with the network; the counts of all others are joined with the documents' words by Spark.

Counts and weights are aggregated by Spark; the driver holds one network (about 0.4 MB) and the counts of `SHARED` words, whatever the input. With
more input, more words are counted and more tasks send weights.

Cases: null and empty texts have no words and a score of 0; words never seen in training count as words of their
bucket that were seen once; equal
rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiline.llm.common import WORD, small_batches, stored

BRANCH = 16
VOCABULARY = BRANCH**3
HASHED = 1024  # tokens at the end of the vocabulary that share the rarer words
SHARED = 100_000  # bucketed words whose counts every task holds; it only saves joined rows
SIDE = 2
WIDTH = 8
HIDDEN = 16
BATCH = 16_384
RATE = 0.15
ROUNDS = 2
BLOCK = 4096  # weights in a row, when they are averaged
MEMO = 200_000
PAD = VOCABULARY


def bucketed(word: str) -> int:
    """The token of a word that is not among the most frequent ones."""
    return VOCABULARY - HASHED + zlib.crc32(word.encode()) % HASHED


class Network:
    """Weights, the id of each known word, and the token and the gain of each id.

    Ids below `VOCABULARY` are tokens. The gain is the log of the share that a word has of its token; an id of a bucket stands for
    a word seen once, and `rest` (word, n) holds the counts of words that are neither known nor seen once.
    """

    def __init__(self, known: dict[str, int], counts: np.ndarray, seed: int = 3, shared: tuple[tuple[str, int], ...] = (), rest: DataFrame | None = None):
        rng = np.random.default_rng(seed)
        self.rest = rest
        whole = np.zeros(VOCABULARY + 1)
        whole[VOCABULARY - HASHED : VOCABULARY] = -np.log(counts[VOCABULARY - HASHED :] + 1)
        tokens = np.array([bucketed(w) for w, _ in shared], np.int64)
        self.known = {**known, **{w: VOCABULARY + 1 + i for i, (w, _) in enumerate(shared)}}
        self.token = np.concatenate([np.arange(VOCABULARY + 1), tokens])
        self.gain = np.concatenate([whole, np.log([n for _, n in shared]) + whole[tokens]])
        share = counts.astype(np.float64) + 0.5
        self.weights = {
            "embed": rng.normal(0, 0.3, (VOCABULARY + 1, WIDTH)).astype(np.float32),
            "hidden": rng.normal(0, 0.2, (2 * SIDE * WIDTH, HIDDEN)).astype(np.float32),
            "shift": np.zeros(HIDDEN, np.float32),
        }
        for level in range(3):
            nodes = BRANCH**level
            mass = share.reshape(nodes, BRANCH, -1).sum(2)
            # the last hidden unit is always 1, so its weight is the bias of the branch
            out = self.weights[f"out{level}"] = np.zeros((nodes, BRANCH, HIDDEN + 1), np.float32)
            out[:, :, HIDDEN] = np.log(mass / mass.sum(1, keepdims=True))
        self.squares: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rest": None}

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, w in self.weights.items():
            self.weights[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def ids(self, words: list[str], memo: dict[str, int]) -> np.ndarray:
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            at = self.known.get(w)
            memo[w] = bucketed(w) if at is None else at
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def tokens(self, text: str | None, memo: dict[str, int]) -> np.ndarray:
        return self.token[self.ids(WORD.findall((text or "").lower()), memo)]

    def forward(self, context: np.ndarray, target: np.ndarray) -> tuple:
        """Log-probability of each target, and what the backward step needs, in the order of the nodes.

        The rows are ordered once, by their node in the last level of the tree: the nodes above are runs of that order too.
        """
        w, n = self.weights, len(target)
        order = np.argsort((target // BRANCH).astype(np.uint16), kind="stable")
        context, target = context[order], target[order]
        x = w["embed"][context].reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), np.float32)
        np.maximum(x @ w["hidden"] + w["shift"], 0, out=h[:, :HIDDEN])
        total = np.zeros(n)
        kept = []
        rows, ones = np.arange(n), np.ones(BRANCH, np.float32)
        for level in range(3):
            ends = np.cumsum(np.bincount(target // BRANCH ** (3 - level), minlength=BRANCH**level)).tolist()
            digit = target // BRANCH ** (2 - level) % BRANCH
            logits = np.empty((n, BRANCH), np.float32)
            parts = [(k, a, z) for k, (a, z) in enumerate(zip([0, *ends], ends)) if z > a]
            for k, a, z in parts:
                np.matmul(h[a:z], w[f"out{level}"][k].T, out=logits[a:z])
            np.clip(logits, -60, 60, out=logits)
            total += logits[rows, digit]
            p = np.exp(logits, out=logits)
            norm = p @ ones
            total -= np.log(norm)
            kept.append((parts, p, norm, digit))
        found = np.empty(n)
        found[order] = total
        return found, context, x, h, kept

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One Adagrad step on the mean loss of a batch."""
        w, n = self.weights, len(target)
        _, context, x, h, kept = self.forward(context, target)
        grads = {}
        dh, rows = np.zeros_like(h), np.arange(n)
        for level, (parts, p, norm, digit) in enumerate(kept):
            p /= (norm * n)[:, None]
            p[rows, digit] -= 1 / n
            grads[f"out{level}"] = out = np.zeros_like(w[f"out{level}"])
            back = np.empty_like(h)
            for k, a, z in parts:
                np.matmul(p[a:z].T, h[a:z], out=out[k])
                np.matmul(p[a:z], w[f"out{level}"][k], out=back[a:z])
            dh += back
        dh = dh[:, :HIDDEN] * (h[:, :HIDDEN] > 0)
        grads["hidden"], grads["shift"] = x.T @ dh, np.ones(n, np.float32) @ dh
        dx = (dh @ w["hidden"].T).reshape(-1, WIDTH)
        flat = context.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        names, starts = np.unique(flat[order], return_index=True)
        grads["embed"] = np.zeros_like(w["embed"])
        grads["embed"][names] = np.add.reduceat(dx[order], starts, axis=0)
        for k, g in grads.items():
            s = self.squares.setdefault(k, np.full_like(g, 1e-8))
            s += g * g
            w[k] -= rate * g / np.sqrt(s)


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context tokens and target of each word of a few documents, and the document of each."""
    edge = np.full(SIDE, PAD)
    flat = np.concatenate([edge, *(x for d in docs for x in (d, edge))])
    at = np.flatnonzero(flat != PAD)
    around = [k for k in range(-SIDE, SIDE + 1) if k]
    return flat[at[:, None] + around], flat[at], np.repeat(np.arange(len(docs)), [len(d) for d in docs])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; each task counts what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                found.update(WORD.findall((t or "").lower()))
            if len(found) > MEMO:
                yield rows()
                found.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start(docs: DataFrame) -> Network:
    """A network with the vocabulary and the word counts of all documents."""
    counts = stored(word_counts(docs))
    # Stored first: the driver gets the chosen rows alone, not those of every task.
    top = stored(counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY - HASHED + SHARED)).collect()
    top.sort(key=lambda r: (-r["n"], r["word"]))
    own, shared = top[: VOCABULARY - HASHED], top[VOCABULARY - HASHED :]
    mass = np.zeros(VOCABULARY)
    mass[: len(own)] = [r["n"] for r in own]
    bucket = (F.crc32(F.col("word").cast("binary")) % HASHED).cast("int").alias("bucket")
    after = lambda r: (F.col("n") < r["n"]) | ((F.col("n") == r["n"]) & (F.col("word") > r["word"]))
    if own:
        for r in counts.filter(after(own[-1])).groupBy(bucket).agg(F.sum("n").alias("n")).collect():  # HASHED rows at most
            mass[VOCABULARY - HASHED + r["bucket"]] = r["n"]
    rest = counts.filter(after(top[-1]) & (F.col("n") > 1)) if shared else None
    return Network({r["word"]: i for i, r in enumerate(own)}, mass, shared=tuple((r["word"], r["n"]) for r in shared), rest=rest)


def train(docs: DataFrame, rounds: int = ROUNDS) -> Network:
    """Train on every document once."""
    small_batches(docs.sparkSession, 200)
    net = start(docs)
    turn = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        net = averaged(docs.filter(F.col("text").isNotNull()).filter(turn == k).select("text"), net)
    return net


def averaged(texts: DataFrame, net: Network) -> Network:
    """The mean of the networks that the tasks train on their texts, weighted by words."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        seen, context, target, held = 0, [], [], 0
        net.squares = {}
        for b in batches:
            c, t, _ = windows([net.tokens(x, memo) for x in b.column("text").to_pylist()])
            context.append(c)
            target.append(t)
            held += len(t)
            if held >= BATCH:
                cs, ts = np.concatenate(context), np.concatenate(target)
                whole = held // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    net.learn(cs[at : at + BATCH], ts[at : at + BATCH])
                seen += whole
                context, target, held = [cs[whole:]], [ts[whole:]], held - whole
        if held:
            net.learn(np.concatenate(context), np.concatenate(target))
            seen += held
        if seen:
            flat = net.flat()
            parts = [flat[a : a + BLOCK] for a in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["block", "words", "weights"],
            )

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        words: Counter = Counter()
        for b in batches:
            for k, n, v in zip(*(b.column(c).to_pylist() for c in ("block", "words", "weights")), strict=True):
                sums[k] = sums.get(k, 0.0) + n * np.frombuffer(v, np.float32).astype(np.float64)
                words[k] += n
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([(sums[k] / words[k]).astype(np.float32).tobytes() for k in keys], pa.binary())], ["block", "weights"]
            )

    rows = texts.mapInArrow(fit, "block int, words long, weights binary").repartition("block").mapInArrow(mean, "block int, weights binary").collect()
    if not rows:
        return net
    out = copy.copy(net)
    out.rest, out.weights, out.squares = net.rest, dict(net.weights), {}
    return out.load(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every document; the mean of no tokens is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            texts = [WORD.findall((t or "").lower()) for t in b.column("text").to_pylist()]
            ids = [net.ids(t, memo) for t in texts]
            context, target, owner = windows([net.token[i] for i in ids])
            sums = np.array([net.gain[i].sum() for i in ids])
            for at in range(0, len(target), 4 * BATCH):
                part = slice(at, at + 4 * BATCH)
                sums += np.bincount(owner[part], weights=net.forward(context[part], target[part])[0], minlength=len(ids))
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            open_ = [Counter(t[k] for k in np.flatnonzero((i >= VOCABULARY - HASHED) & (i < VOCABULARY)).tolist()) for t, i in zip(texts, ids, strict=True)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in open_])]), pa.int32())
            words = pa.ListArray.from_arrays(ends, pa.array([w for c in open_ for w in c], pa.string()))
            times = pa.ListArray.from_arrays(ends, pa.array([n for c in open_ for n in c.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(sizes), pa.array(sums), words, times], ["row", "doc_id", "n_tokens", "total", "words", "times"])

    small_batches(docs.sparkSession, 200)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "row long, doc_id long, n_tokens long, total double, words array<string>, times array<long>")
    total = F.col("total")
    if net.rest is not None:
        found = stored(found)  # fixes the row numbers
        spots = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
        # Whole billionths, so that sums do not depend on the order of the rows.
        logs = net.rest.select(F.col("word").alias("words"), F.round(F.log("n") * 1e9).cast("long").alias("log"))
        more = spots.join(logs, "words").groupBy("row").agg((F.sum(F.col("times") * F.col("log")) / 1e9).alias("more"))
        found = found.join(more, "row", "left")
        total = total + F.coalesce("more", F.lit(0.0))
    return found.select("doc_id", "n_tokens", total.alias("log_prob"), (total / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"))
