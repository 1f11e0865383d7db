"""Hard negatives by exact integer scores: products of residue matrices in float32 and Chinese remaindering.

Components become the integers floor(256 * x). A block of anchors meets a block of rows as matrix products modulo several
small primes: residues lie around zero, so that `INNER` products of them add up exactly in float32, and longer vectors are
reduced after every `INNER` components. The signed score is put together from its residues by mixed radix digits around zero.
The number of primes follows from the longest vector: by Cauchy and Schwarz no score is beyond its squared length.

Anchors (the stated queries) are dealt into blocks of at most `ANCHORS`, rows into blocks that are streamed, and every
pair of blocks is one group of a shuffle. A pass keeps the best `POSITIVES` rows of the anchor's label in each pair of blocks,
a second one the best `NEGATIVES` rows of other labels in the window of each positive; windows over these few merge the blocks.

Cases: rows with a null id, label or vector, or with any null or non-finite component, take no part, nor do rows whose
integer vector has a squared length of 2**62 or more, as scores would not fit into a long. Equal rows (id, label, vector) count
once; rows that share an id alone are rows of their own, but never partners of one another. Vectors meet those of their own length
only; an empty vector scores 0. A label is any integer. An anchor without other rows of its label gives no row. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiline.llm.common import shuffle_partitions, small_batches, stored

SCALE = 256
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative scores between 50 and 95 hundredths of its positive.
LOW, HIGH = 50, 95
#: So many products of residues up to 511 add up exactly in float32.
INNER = 64
ANCHORS = 16_384
ROWS = 262_144
#: Anchors of one matrix product; the product has this many rows.
SLICE = 1_024
BATCH = 2_048


def small_primes(limit: int = 1024) -> list[int]:
    """Primes below the limit, the largest first."""
    return [p for p in range(limit - 1, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]


def primes_for(bound: int) -> list[int]:
    """As many primes as signed values up to `bound` need, with room to spare for digits a little beyond a half."""
    product = 1
    for n, p in enumerate(small_primes()):
        product *= p
        if product > 2.2 * bound + 2:
            return small_primes()[: n + 1]
    raise ValueError("bound too large")


def around_zero(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of float32 integers below 2**24, around zero."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Component matrices modulo each prime, around zero, from a matrix of longs."""
    out = []
    for p in primes:
        r = np.mod(x, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (rows of a, rows of b) as longs, from residue matrices."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        r = np.zeros((len(a[k]), len(b[k])), dtype=np.float32)
        for at in range(0, a[k].shape[1], INNER):
            r += around_zero(a[k][:, at : at + INNER] @ b[k][:, at : at + INNER].T, p)
            if at:
                r = around_zero(r, p)
        # mixed radix: what the digits before leave, divided by their primes
        for q, d in zip(primes, digits, strict=False):
            inverse = pow(q, -1, p)
            inverse -= p if inverse > p // 2 else 0
            r = around_zero(around_zero(r - d, p) * np.float32(inverse), p)
        digits.append(r)
    out = digits[-1].astype(np.int64)
    with np.errstate(over="ignore"):
        for p, d in zip(primes[-2::-1], digits[-2::-1], strict=True):
            out = out * p + d.astype(np.int64)
    return out


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x, twin) of the rows that take part; twin tells rows of one id apart."""
    e = F.col("embedding").cast("array<double>")
    # finite: its difference from itself is 0
    whole = F.forall(e, lambda c: c.isNotNull() & (F.coalesce(c - c, F.lit(1.0)) == 0.0))
    length = F.aggregate(e, F.lit(0.0), lambda s, c: s + F.pow(c * SCALE, F.lit(2.0)) + 2 * F.abs(c * SCALE) + 1)
    label = F.col("label").cast("long")
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .filter(whole & (length < 2.0**62))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            F.transform(e, lambda c: F.floor(c * SCALE)).alias("x"),
        )
        .withColumn("twin", F.xxhash64("label", "x"))
    )


def tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Pairs of blocks, anchors before rows: (a, r, width, side, vec_id, label, x, twin, low, high)."""
    across = max(1, -(-n_anchors // ANCHORS))
    down = max(1, -(-n_rows // ROWS), min(-(-n_rows // BATCH), -(-shuffle_partitions(rows.sparkSession) // across)))
    place = F.xxhash64("vec_id", "twin")
    none = F.lit(None).cast("array<long>")
    held = anchors.select(
        F.pmod(place, F.lit(across)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"), F.lit(0).alias("side"), "vec_id", "label", "x", "twin", "low", "high"
    )
    streamed = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"), F.pmod(place, F.lit(down)).cast("int").alias("r"), F.lit(1).alias("side"), "vec_id", "label", "x", "twin", none.alias("low"), none.alias("high")
    )
    both = held.unionAll(streamed).withColumn("width", F.size("x"))
    order = ["a", "r", "width"]
    return both.repartition(down * across, *order[:2]).sortWithinPartitions(*order, "side")


class Best:
    """The best rows so far of many windows: at most `keep` per window, by score, then id."""

    def __init__(self, windows: int, keep: int):
        self.keep = keep
        self.floor = np.full(windows, np.iinfo(np.int64).min)
        self.found: tuple[np.ndarray, ...] = (np.empty(0, np.int64),) * 4

    def add(self, window: np.ndarray, score: np.ndarray, vec_id: np.ndarray, twin: np.ndarray) -> None:
        if not len(window):
            return
        w, s, v, t = (np.concatenate([old, new]) for old, new in zip(self.found, (window, score, vec_id, twin), strict=True))
        order = np.lexsort((t, v, -s, w))
        w, s, v, t = w[order], s[order], v[order], t[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        rank = np.arange(len(w)) - np.repeat(first, np.diff(np.r_[first, len(w)]))
        last = rank == self.keep - 1
        self.floor[w[last]] = s[last]
        stay = rank < self.keep
        self.found = (w[stay], s[stay], v[stay], t[stay])


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """The lists of a slice of rows, all of one length, as a matrix of longs."""
    c = column.combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def mine(pairs: DataFrame, primes: list[int], windows: int, keep: int, alike: bool) -> DataFrame:
    """The best `keep` rows of each window of each anchor in each pair of blocks; alike: of its own label."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        best: Best | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held is None or best is None or not len(best.found[0]):
                return
            w, s, v, t = best.found
            i = w // windows
            columns = [held["vec_id"][i], held["twin"][i], (w % windows).astype(np.int32), s, v, t]
            for at in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["anchor_id", "anchor_twin", "slot", "score", "vec_id", "twin"])

        for key, side, part in runs(batches):
            if held is None or held["key"] != key:
                yield from flush()
                held, best = {"key": key, "parts": []}, None
            if side == 0:
                held["parts"].append(part)
                continue
            if not held["parts"] and best is None:
                continue
            if best is None:
                t = pa.concat_tables(held["parts"])
                held |= {c: t.column(c).to_numpy() for c in ("vec_id", "label", "twin")}
                held["x"] = residues(matrix(t.column("x"), t.num_rows), primes)
                held |= {c: matrix(t.column(c), t.num_rows) for c in ("low", "high")}
                held["parts"], best = [], Best(t.num_rows * windows, keep)
            ids, labels, twins = (part.column(c).to_numpy() for c in ("vec_id", "label", "twin"))
            x = residues(matrix(part.column("x"), part.num_rows), primes)
            for a in range(0, len(held["vec_id"]), SLICE):
                z = min(a + SLICE, len(held["vec_id"]))
                scores = products([m[a:z] for m in held["x"]], x, primes)
                fit = (held["label"][a:z, None] == labels[None, :]) == alike
                fit &= held["vec_id"][a:z, None] != ids[None, :]
                for k in range(windows):
                    spot = np.arange(a, z) * windows + k
                    least = np.maximum(held["low"][a:z, k], best.floor[spot])
                    i, j = np.nonzero(fit & (scores >= least[:, None]) & (scores <= held["high"][a:z, k, None]))
                    best.add(spot[i], scores[i, j], ids[j], twins[j])
        yield from flush()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.Table]]:
        """Slices of one pair of blocks, vector length and side, at most `BATCH` rows each."""
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            names = ("a", "r", "width", "side")
            x = np.stack([t.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero(np.r_[True, (x[:, 1:] != x[:, :-1]).any(0), True])
            for i, j in itertools.pairwise(cuts.tolist()):
                for at in range(i, j, BATCH):
                    yield tuple(x[:3, i].tolist()), int(x[3, i]), t.slice(at, min(BATCH, j - at))

    small_batches(pairs.sparkSession, BATCH)
    return pairs.mapInArrow(search, "anchor_id long, anchor_twin long, slot int, score long, vec_id long, twin long")


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    rows = stored(integer_rows(vectors).dropDuplicates(["vec_id", "label", "x"]))
    longest = F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(c.cast("double"), F.lit(2.0))))
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors, most = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), longest).first()
    primes = primes_for(int((most or 0.0) * 1.0001) + 1)
    no_low, no_high = -(1 << 63), (1 << 63) - 1
    anchors = rows.filter(is_anchor)
    open_window = anchors.withColumn("low", F.array(F.lit(no_low))).withColumn("high", F.array(F.lit(no_high)))
    of_anchor = ["anchor_id", "anchor_twin"]
    found = mine(tiles(rows, open_window, n, n_anchors), primes, 1, positives, True)
    order = Window.partitionBy(*of_anchor).orderBy(F.col("score").desc(), "vec_id", "twin")
    pos = stored(
        found.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= positives)
        .select(*of_anchor, (F.col("n") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # hundredths of a score in whole numbers: the least and the greatest negative score that fit
    hundredths = F.col("positive_score").cast("decimal(38,0)")
    bounds = pos.withColumn("least", F.ceil(hundredths * low / 100).cast("long")).withColumn("most", F.floor(hundredths * high / 100).cast("long"))
    windows = bounds.groupBy(*of_anchor).agg(F.sort_array(F.collect_list(F.struct("slot", "least", "most"))).alias("w"))
    # slots that no positive fills have an empty window
    padded = [
        F.array(*(F.coalesce(F.get(F.col("w"), i)[bound], F.lit(void)) for i in range(positives))).alias(name)
        for name, bound, void in (("low", "least", no_high), ("high", "most", no_low))
    ]
    queries = anchors.join(
        windows.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_twin").alias("twin"), *padded), ["vec_id", "twin"]
    )
    found = mine(tiles(rows, queries, n, n_anchors), primes, positives, negatives, False)
    order = Window.partitionBy(*of_anchor, "slot").orderBy(F.col("score").desc(), "vec_id", "twin")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return top.join(pos, [*of_anchor, "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
