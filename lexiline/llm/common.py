"""Shared pieces of the text and vector operators: stored tables, words, tiles of large groups, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline import session

WORD = re.compile(r"\w+")


_SCOPES: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder of checkpoints and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{session.ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths of the tables that are stored inside it, for `forget`."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [p for p in _SCOPES if p is not paths]


def forget(spark: SparkSession, paths: list[str], but_for: DataFrame | None = None) -> None:
    """Delete stored tables that nothing reads any more; those that `but_for` reads from stay."""
    used = but_for.inputFiles() if but_for is not None else []
    for path in list(paths):
        if not any(path.rsplit("/", 1)[1] in f for f in used):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            paths.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (src, dst), any orderable type: (node, component) for every node with an edge.

    Alternates two steps until nothing changes: all larger neighbours of a node, then all smaller ones, are tied to the
    smallest. Only per-node minima and edges are shuffled; the driver sees two numbers per round. A hub's edges are joined
    with one row for the hub, so a large hub is split like any skewed join side.
    """
    spark = edges.sparkSession
    with scope() as last:
        pairs = stored(
            edges.filter("src is not null and dst is not null and src <> dst")
            .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
            .distinct()
        )
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("m"))
        tied = large.join(low, F.col("b") == F.col("k"))
        small = tied.filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(low.select(F.col("m").alias("x"), F.col("k").alias("y")))
        with scope() as new:
            pairs = stored(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        forget(spark, last)  # a round reads only the one before
        last = new
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select("a").distinct()
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups, and the bounds of each group, from batches sorted by the long or int columns `by`."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        held = now if held is None else pa.concat_tables([held, now])
        starts = starts_of(held, by)
        if len(starts) < 2:
            continue
        ready = held.slice(0, starts[-1]).combine_chunks()
        yield ready, list(zip(starts[:-1], starts[1:], strict=True))
        held = held.slice(starts[-1])
    if held is not None:
        starts = starts_of(held, by)
        yield held.combine_chunks(), list(zip(starts, [*starts[1:], held.num_rows], strict=True))


def starts_of(t: pa.Table, by: tuple[str, ...]) -> list[int]:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in by:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new).tolist()


def covered(keys: list[np.ndarray], key: int) -> np.ndarray:
    """Which pairs of members share a bucket before `key`: such a pair is counted there."""
    early = [k[k < key] for k in keys]
    names, columns, counts = np.unique(np.concatenate(early), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    _, columns = np.unique(columns[shared], return_inverse=True)
    out = np.zeros((len(keys), len(keys)), dtype=bool)
    if len(columns):
        rows = np.repeat(np.arange(len(keys)), [len(k) for k in early])[shared]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        for first in range(0, int(columns[-1]) + 1, 4096):
            a, z = np.searchsorted(columns, [first, first + 4096])
            held = np.zeros((len(keys), min(4096, int(columns[-1]) + 1 - first)), dtype=np.float32)
            held[rows[a:z], columns[a:z] - first] = 1
            out |= held @ held.T > 0
    return out


BLOCK_ROWS = 1024
BLOCK_COST = 400_000


def link(
    memberships: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    linked: Callable[[list], np.ndarray],
    possible: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Links inside buckets: (node, links, root) per node and tile that holds a link of it.

    `memberships` (key long, node binary, cost long) puts nodes into buckets, `load` adds weight (long) and value (an array)
    to rows that have a node, and `linked(values)` tells for a few nodes which pairs are linked; `possible(costs)` rules out
    pairs by their costs alone. A pair that shares several buckets
    counts in the first of them alone. Buckets of equal members are taken once. A large bucket is cut into blocks, and each
    pair of blocks is a task of bounded size. Values travel only to tiles that have a pair to compare. `links` is
    the weight of linked nodes, `root` the first node of the linked part inside the tile.
    """
    spark = memberships.sparkSession
    small_batches(spark, 256)
    sizes = memberships.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("cost").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")
    )
    once = sizes.filter("n > 1").groupBy("n", "total", "x", "lo", "hi").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_COST)).cast("int")
    live = stored(memberships.join(once.select("key", blocks.alias("blocks")), "key").select("key", "node", "cost", "blocks"))
    keys = live.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    tiles = (
        live.join(keys, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "cost", "keys")
    )
    shape = "key long, i int, j int, block int, node binary, cost long, keys array<long>"

    def open_pairs(t: pa.Table, a: int, z: int, key: int, keys: list[np.ndarray]) -> np.ndarray:
        blocks = t.column("block").to_numpy()[a:z]
        out = ~covered(keys, key)
        if possible is not None:
            out &= possible(t.column("cost").to_numpy()[a:z])
        np.fill_diagonal(out, False)
        if t.column("i")[a].as_py() != t.column("j")[a].as_py():
            out &= blocks[:, None] != blocks[None, :]
        return out

    def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
        c = column.combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        flat, ends = c.values.to_numpy(), c.offsets.to_numpy()
        return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, ("key", "i", "j")):
            ks, keys = t.column("key").to_numpy(), lists(t.column("keys"))
            keep = np.zeros(t.num_rows, dtype=bool)
            for a, z in bounds:
                if z - a > 1:
                    keep[a:z] = open_pairs(t, a, z, int(ks[a]), keys[a:z]).any(1)
            yield from t.filter(pa.array(keep)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, ("key", "i", "j")):
            ks, keys, found = t.column("key").to_numpy(), lists(t.column("keys")), lists(t.column("value"))
            weights, nodes = t.column("weight").to_numpy(), t.column("node").to_pylist()
            out: list[tuple] = []
            for a, z in bounds:
                if z - a < 2:
                    continue
                fresh = open_pairs(t, a, z, int(ks[a]), keys[a:z])
                same = linked(found[a:z]) & fresh
                links = same @ weights[a:z]
                label = np.arange(z - a)
                while True:
                    low = np.minimum(label, np.where(same, label[None, :], z - a).min(1))
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                out += [(nodes[a + i], int(links[i]), nodes[a + label[i]]) for i in np.flatnonzero(links)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["node", "links", "root"]
                )

    order = ["key", "i", "j"]
    wanted = stored(tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(needed, shape))
    loaded = load(wanted).select(*order, "block", "node", "cost", "keys", "weight", "value")
    return loaded.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "node binary, links long, root binary")


def classes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, links, component) of every node of `nodes` (node, ...), from what `link` found."""
    found = stored(found)
    comps = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return (
        nodes.select("node")
        .join(links, "node", "left")
        .join(comps, "node", "left")
        .select("node", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "node").alias("component"))
    )
