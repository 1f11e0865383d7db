"""Chosen-path join of word n-gram sets by Jaccard similarity.

A document is the set of its `WORDS`-word shingles (64-bit digests); shorter texts are one shingle. Documents with equal
sets are one node. In each run a shared hash picks about 1 / `threshold` of a set's shingles, and the node goes to
one bucket per pick: two sets at the threshold share at least one pick on average, so a run misses a pair with
a chance of 1/e at most, and `runs_for` repeats runs until the target recall. A bucket of more than `LARGE` nodes is split
again by shingles picked with a hash of its path, unless its sets are alike on average (`DENSE`); sets that share less
than the threshold get fewer with each split. A split picks one shared shingle on average, so that the number of buckets of a set stays
what it is; the first split picks `FIRST_PICKS` of them, which repeats the runs for the members of large buckets alone. `recall_at` tells
what a pair exactly at the threshold has left when all its buckets are split: 0.9999 without splits, 0.99 at least after
all `DEPTH` of them (closer pairs keep more). Alike sets and small buckets are compared by exact Jaccard
similarity, in tiles. Buckets that are still large after `DEPTH` splits are compared all the same: no bucket is
capped or dropped.

`join` returns one row per document: doc_id, n_shingles, n_links (other documents at the threshold, copies included) and
class_id (smallest doc_id that links reach).

Cases: null and empty texts have no shingles, link with nothing and are classes of their own; equal rows are copies of
one another; null ids count as documents, and a class without any id has a null class_id; an empty table gives an
empty result; extra columns are ignored by `join` and kept by `keep_first`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiline.llm.common import WORD, classes, link, small_batches, stored

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
SPARE = 1.25  # runs more than unsplit buckets need
FIRST_PICKS = 3  # picks that a pair at the threshold shares on average in the first split of a bucket
LARGE = 100
DENSE = 0.5
PROBES = 24, 200  # shingles and sets of a bucket that tell how alike its sets are
DEPTH = 8
MEMO = 200_000
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def runs_for(recall: float) -> int:
    return max(1, math.ceil(SPARE * math.log(1 / (1 - recall))))


def survival(splits: int) -> float:
    """Chance that a pair that shares one pick a split on average is still together after so many splits."""
    kept = 1.0
    for _ in range(splits):
        kept = 1 - math.exp(-kept)
    return kept


def recall_at(splits: int, runs: int) -> float:
    """Chance that a pair at the threshold meets if all its buckets are split so many times."""
    below = 1 - math.exp(-FIRST_PICKS * survival(splits - 1)) if splits else 1.0
    return 1 - math.exp(-below) ** runs


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(ODD[2])
    return x ^ (x >> np.uint64(31))


def text_key():
    """A 128-bit digest of the text."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


class Shingler:
    """Shingle sets of texts, with a memo of word digests."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.memo: dict[str, int] = {}
        self.factors = [np.uint64(pow(ODD[0], k + 1, 1 << 64) | 1) for k in range(words)]

    def digests(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = set(words).difference(memo)
        memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def rolled(self, w: np.ndarray, k: int) -> np.ndarray:
        out = np.full(max(0, len(w) - k + 1), k, dtype=np.uint64)
        for i in range(k):
            out += mixed(w[i : i + len(out)] + np.uint64(i)) * self.factors[i]
        return mixed(out)

    def in_order(self, words: list[str]) -> np.ndarray:
        """Digests of the shingles in the order of the words; fewer words than a shingle has are one shingle."""
        return self.rolled(self.digests(words), min(self.words, len(words))) if words else np.zeros(0, dtype=np.uint64)

    def batch(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """`in_order` of several texts, one after the other, and the bounds of each."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        w = self.digests([x for t in texts for x in t])
        rolled = self.rolled(w, self.words)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.where(sizes >= self.words, sizes - self.words + 1, np.minimum(sizes, 1))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(starts[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
        out = rolled[np.minimum(at, len(rolled) - 1)] if len(rolled) else np.zeros(bounds[-1], dtype=np.uint64)
        for i in np.flatnonzero((sizes > 0) & (sizes < self.words)):
            out[bounds[i]] = self.rolled(w[starts[i] : starts[i + 1]], int(sizes[i]))[0]
        return out, bounds

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """`of` for several texts."""
        flat, bounds = self.batch([WORD.findall((t or "").lower()) for t in texts])
        return [np.unique(flat[at:end]) for at, end in zip(bounds[:-1], bounds[1:], strict=True)]

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct digests of the shingles of a whole text."""
        return np.unique(self.in_order(WORD.findall((text or "").lower())))


def node_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def picked(shingles: np.ndarray, seed: int, expected: float) -> np.ndarray:
    """Hashes of the shingles that a shared hash picks, about `expected` of the set."""
    h = mixed(shingles ^ np.uint64(seed))
    return h if expected >= len(h) else h[h < limit(expected, len(h))]


def limit(expected: float, size: int) -> np.uint64:
    return np.uint64(int(2.0**64 * (expected / size)))


def sets(docs: DataFrame, threshold: float, recall: float, words: int) -> DataFrame:
    """(doc_id, tk, node, n, picks): the set of each document and its buckets in all runs; `tk` is a digest of the text."""
    seeds = mixed(np.arange(1, runs_for(recall) + 1, dtype=np.uint64) * np.uint64(ODD[3]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            found = shingler.sets(b.column("text").to_pylist())
            sizes = np.array([len(s) for s in found], dtype=np.int64)
            flat = np.concatenate(found) if len(found) else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(found)), sizes)
            share = np.array([limit(1 / threshold, n) if n > 1 / threshold else 0 for n in sizes.tolist()], dtype=np.uint64)
            bound, all_of = share[owner], (sizes <= 1 / threshold)[owner]
            who, keys = [], []
            for seed in seeds:
                h = (flat ^ seed) * np.uint64(ODD[1])
                h ^= h >> np.uint64(32)
                h *= np.uint64(ODD[2])
                at = np.flatnonzero((h < bound) | all_of)
                who.append(owner[at])
                keys.append(h[at] ^ seed)
            who, keys = np.concatenate(who), np.concatenate(keys)
            order = np.argsort(who, kind="stable")
            ends = np.searchsorted(who[order], np.arange(len(found) + 1)).astype(np.int32)
            picks = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64)))
            nodes = pa.array([node_of(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), nodes, pa.array(sizes), picks], ["doc_id", "tk", "node", "n", "picks"])

    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    return source.mapInArrow(run, "doc_id long, tk binary, node binary, n long, picks array<long>")


def split(members: DataFrame, texts: DataFrame, threshold: float, words: int, picks: float) -> tuple[DataFrame, DataFrame]:
    """Keys of large buckets whose sets are alike, and the buckets below the others: (key), (key, node, cost, size).

    `members` (key, node, cost, size) come with the size of their bucket, `texts` (node, text) holds a text of each set.
    """
    shingles, sets_probed = PROBES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            at, parents, kinds, hashes = [], [], [], []
            found = shingler.sets(b.column("text").to_pylist())
            for i, (s, node, buckets) in enumerate(zip(found, b.column("node").to_pylist(), b.column("buckets").to_pylist(), strict=True)):
                for bucket in buckets:
                    key = bucket["key"]
                    seed = int(mixed(np.array([key], dtype=np.int64).view(np.uint64) ^ np.uint64(ODD[4]))[0])
                    parts = [picked(s, seed, picks / threshold) ^ np.uint64(seed)]
                    if xxhash.xxh3_64_intdigest(node, seed=seed) < sets_probed / bucket["size"] * 2.0**64:
                        parts.append(picked(s, seed ^ ODD[2], shingles))
                    for kind, h in enumerate(parts):
                        at += [i] * len(h)
                        parents += [key] * len(h)
                        kinds += [kind] * len(h)
                        hashes.append(h)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hashes).view(np.int64) if hashes else [], pa.int64()),
                    pa.array(parents, pa.int64()),
                    b.column("node").take(rows),
                    b.column("cost").take(rows),
                    pa.array(kinds, pa.int32()),
                ],
                ["key", "parent", "node", "cost", "probe"],
            )

    by_node = members.groupBy("node", "cost").agg(F.collect_list(F.struct("key", "size")).alias("buckets"))
    rows = stored(by_node.join(texts, "node").select("node", "cost", "buckets", "text").mapInArrow(run, "key long, parent long, node binary, cost long, probe int"))
    probes = rows.filter("probe = 1")
    shares = probes.groupBy("parent", "key").agg(F.count("*").cast("double").alias("c"))
    probed = probes.select("parent", "node").distinct().groupBy("parent").agg(F.count("*").cast("double").alias("m"))
    likeness = shares.groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("c")).join(probed, "parent")
    dense = likeness.filter(F.col("cc") >= DENSE * F.col("c") * F.col("m")).select(F.col("parent").alias("key"))
    below = several(rows.filter("probe = 0").select("key", "parent", "node", "cost"))
    below = below.join(dense.select(F.col("key").alias("parent")), "parent", "left_anti")
    return dense, below.select("key", "node", "cost", "size")


def several(members: DataFrame) -> DataFrame:
    """The members of buckets of two nodes or more, with the size of their bucket."""
    return members.join(members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key")


def alike(threshold: float):
    """For shingle sets: which pairs have a Jaccard similarity of at least the threshold."""

    def linked(found: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(s) for s in found], dtype=np.float64)
        if len(found) == 2:
            both = np.full((2, 2), float(len(np.intersect1d(found[0], found[1], assume_unique=True))))
        else:
            both = np.zeros((len(found), len(found)))
            _, columns, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            rows = np.repeat(np.arange(len(found)), sizes.astype(np.int64))
            shared = counts[columns] > 1
            rows, (_, columns) = rows[shared], np.unique(columns[shared], return_inverse=True)
            order = np.argsort(columns, kind="stable")
            rows, columns = rows[order], columns[order]
            for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
                a, z = np.searchsorted(columns, [first, first + 4096])
                held = np.zeros((len(found), min(4096, int(columns[-1]) + 1 - first)), dtype=np.float32)
                held[rows[a:z], columns[a:z] - first] = 1
                both += held @ held.T
        return both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9

    return linked


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, n_links, class_id) of every document."""
    return joined(docs, threshold, recall, words).select("doc_id", "n_shingles", "n_links", "class_id")


def loader(texts: DataFrame, words: int):
    """Shingle sets for rows that have a node, from `texts` (node, text, weight): each text is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            found = shingler.sets(b.column("text").to_pylist())
            places = b.column("rows").to_pylist()
            at = [i for i, p in enumerate(places) for _ in p]
            flat = [r for p in places for r in p]
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in flat], kind) for c, kind in (("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()))]
                + [b.column(c).take(rows) for c in ("node", "cost", "keys", "weight")]
                + [pa.array([found[i].view(np.int64) for i in at], pa.list_(pa.int64()))],
                ["key", "i", "j", "block", "node", "cost", "keys", "weight", "value"],
            )

    def load(wanted: DataFrame) -> DataFrame:
        places = wanted.groupBy("node", "cost", "keys").agg(F.collect_list(F.struct("key", "i", "j", "block")).alias("rows"))
        shape = "key long, i int, j int, block int, node binary, cost long, keys array<long>, weight long, value array<long>"
        return places.join(texts, "node").select("node", "cost", "keys", "weight", "rows", "text").mapInArrow(run, shape)

    return load


def joined(docs: DataFrame, threshold: float, recall: float, words: int) -> DataFrame:
    rows = stored(sets(docs, threshold, recall, words))
    known = rows.filter("node is not null")
    weights = stored(known.groupBy("node").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first_id"), F.min("tk").alias("tk")))
    picks = known.select("node", F.col("n").alias("cost"), "picks").dropDuplicates(["node"]).select("node", "cost", F.explode("picks").alias("key"))
    members = stored(several(picks))
    candidates = members.select("node").distinct().join(weights, "node").select("node", "weight", "tk")
    texts = docs.select(text_key().alias("tk"), "text").join(candidates, "tk").dropDuplicates(["tk"]).select("node", "weight", "text")
    texts = stored(texts)
    leaves = members.filter(F.col("size") <= LARGE).select("key", "node", "cost")
    large = members.filter(F.col("size") > LARGE)
    for level in range(1, DEPTH + 1):
        if large.isEmpty():
            break
        dense, below = split(large, texts.select("node", "text"), threshold, words, FIRST_PICKS if level == 1 else 1)
        leaves = leaves.unionAll(large.join(dense, "key", "left_semi").select("key", "node", "cost"))
        members = stored(below)
        leaves = leaves.unionAll(members.filter(F.col("size") <= LARGE).select("key", "node", "cost"))
        large = members.filter(F.col("size") > LARGE)
    leaves = leaves.unionAll(large.select("key", "node", "cost"))

    def compatible(sizes: np.ndarray) -> np.ndarray:
        return np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9

    found = link(leaves, loader(texts, words), alike(threshold), compatible)
    classed = classes(found, weights).join(weights, "node")
    firsts = classed.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_node = classed.join(firsts, "component").select("node", (F.col("links") + F.col("weight") - 1).alias("n_links"), "class_id", F.lit(True).alias("known"))
    return rows.select("doc_id", "tk", "node", F.col("n").alias("n_shingles")).join(by_node, "node", "left").select(
        "doc_id",
        "tk",
        "node",
        "n_shingles",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """One document of each class, the one with the smallest id, in all its columns; of several texts under that id the one with the
    smallest digest. Rows go by id and text, so that another text under the same id stays. Rows without shingles or without an id all
    stay; rows that repeat an id and a text are one document."""
    found = stored(joined(docs, threshold, recall, words).filter("n_shingles > 0 and doc_id is not null").select("doc_id", "tk", "class_id"))
    first = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "tk")).alias("first"))
    gone = stored(
        found.join(first, "class_id").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("tk") != F.col("first.tk"))).select(F.col("doc_id").alias("gone_id"), F.col("tk").alias("gone_tk")).distinct()
    )
    rest = docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (text_key() == F.col("gone_tk")), "left_anti")
    again = found.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id").distinct()
    if again.isEmpty():
        return rest
    alone = rest.join(again, "doc_id", "left_anti").select(*docs.columns)
    return alone.unionAll(rest.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
