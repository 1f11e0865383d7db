"""Token ids in ORC files, in ascending order of doc_id.

Rows are dealt by ranges of doc_id and sorted inside each range, so file names and rows follow the order of the
documents. The ids are a column of integers, which ORC packs by run lengths and bit widths; row indexes every
`ROWS_PER_INDEX` rows and Bloom filters on doc_id let a reader skip files, stripes and row groups. Each
row holds the number of ids before it in its file, so files and stripes can be read in parallel and
placed by one total per file.

Cases: null texts count as empty and hold the end id alone; null ids of documents come first; equal ids of
documents follow one another in the order of a hash of their text, and a salt lets Spark deal them to several ranges;
an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline import session
from lexiline.llm import pieces
from lexiline.llm.common import shuffle_partitions, small_batches

END_ID = 0
STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1000
SCHEMA = "doc_id long, before long, n_ids long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str, partitions: int | None = None) -> str:
    """Encode every whole text, append the end id and write the ORC files below `path`."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    parts = partitions or shuffle_partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = pieces.encoder(vocabulary), 0
        for b in batches:
            ids = enc.encode(b.column("text").to_pylist())
            sizes = np.array([len(i) for i in ids], dtype=np.int64) // np.dtype(enc.dtype).itemsize + 1
            ends = np.cumsum(sizes)
            end = np.array([END_ID], dtype=enc.dtype).tobytes()
            flat = enc.unpack(b"".join([x for i in ids for x in (i, end)])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(before + ends - sizes), pa.array(sizes), lists], ["doc_id", "before", "n_ids", "ids"]
            )
            before += int(ends[-1]) if len(ends) else 0

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.rand(7).alias("salt"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie", "salt")
    (
        ordered.select("doc_id", "text")
        .mapInArrow(run, SCHEMA)
        .write.option("orc.compress", "LZ4")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with the name of their file."""
    return spark.read.schema(SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("file"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; stripes and row groups without them are skipped by statistics and Bloom filters."""
    return read(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def places(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crcs = [zlib.crc32(flat[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("before"), b.column("file"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "before", "file", "n_tokens", "ids_crc32"],
            )

    small_batches(spark, 500)
    rows = read(spark, path)
    totals = rows.groupBy("file").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    digests = rows.drop("n_ids").mapInArrow(run, "doc_id long, before long, file string, n_tokens long, ids_crc32 long")
    return digests.join(bases, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents below the shared folder and describe them from the files."""
    spark = docs.sparkSession
    path = f"{session.ensure_checkpoint_dir(spark).rstrip('/')}/orc-{uuid.uuid4().hex}"
    return places(spark, write(docs, path, vocabulary))
