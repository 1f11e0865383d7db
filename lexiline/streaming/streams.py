"""Structured Streaming operators. Batch logic is reused inside `foreachBatch`; keyed state is bounded."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiline import fixed, session
from lexiline.functions import text
from lexiline.operators import detect, usage


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(session.ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_to_table(
    stream: DataFrame,
    mode: str = "append",
    path: str | None = None,
    each: Callable[[DataFrame], DataFrame] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Drain the available input into a table and read it back.

    With a `path`, the table and the checkpoint of the stream live below it, and a later call goes on where the last
    one stopped. Every batch is a partition of its own, overwritten on a retry, so a repeated batch adds nothing. In
    complete mode the last batch holds the whole result; in update mode the last row of each of the `keys` counts.
    A stream without input gives an empty table.
    """
    spark = stream.sparkSession
    path = path or _folder(spark, "stream")
    table = f"{path}/table"
    shape = spark.createDataFrame([], stream.schema)
    (each(shape) if each else shape).write.mode("ignore").parquet(f"{table}/batch=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = each(batch) if each else batch
        out.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    writer.foreachBatch(sink).start().awaitTermination()
    rows = spark.read.parquet(table)
    if mode == "complete":
        return rows.filter(F.col("batch") == last_batch(rows)).drop("batch")
    if mode == "update":
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return rows.drop("batch")


def last_batch(rows: DataFrame) -> int:
    """Number of the last stored batch that has rows; -1 without one."""
    return rows.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def stream_flag_terms(words: DataFrame, lexicon: DataFrame, path: str | None = None, **scan_kw) -> DataFrame:
    """Token tiers on arriving words; stateless, one dictionary pass per micro-batch."""
    return run_to_table(words, path=path, each=lambda b: detect.scan_tokens(b, lexicon, **scan_kw))


def stream_compounds(
    words: DataFrame,
    pairs: Sequence[tuple[str, str]] = fixed.COMPOUNDS,
    gap_words: Sequence[str] = fixed.GAP_WORDS,
    lexicon: DataFrame | None = None,
    allowlist: Sequence[str] = fixed.ALLOWLIST,
) -> DataFrame:
    """Compounds across micro-batches: (track_id, pos, kind) of every word that takes part in one.

    Kinds are `adjacent`, `gapped` (the filler in between included) and, with a lexicon, `joined`. The state is the last two
    words of a track and stays with it: a timeout by the clock would keep a drained stream from ending. Words of a track
    must arrive in order; a word can be named by several compounds.
    """
    listed, fillers = frozenset("+".join(p) for p in pairs), frozenset(gap_words)
    by_lexicon = lexicon is not None
    least = fixed.JOINED_MIN_LEN

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted(r for pdf in batches for r in zip(pdf["pos"].tolist(), pdf["w"].tolist()))
        seen = list(zip(*state.get)) if state.exists else []
        hits = []
        for pos, w in rows:
            if seen:
                before, last = seen[-1]
                if f"{last}+{w}" in listed:
                    hits.append(([before, pos], "adjacent", None))
                if by_lexicon and len(last) >= least and len(w) >= least:
                    hits.append(([before, pos], "joined", last + w))
                if len(seen) > 1 and last in fillers and f"{seen[-2][1]}+{w}" in listed:
                    hits.append(([seen[-2][0], before, pos], "gapped", None))
            seen = [*seen[-1:], (pos, w)]
        if seen:
            state.update(tuple(zip(*seen)))
        yield pd.DataFrame({"track_id": [key[0]] * len(hits), "at": [h[0] for h in hits], "kind": [h[1] for h in hits], "spelling": [h[2] for h in hits]})

    keyed = words.select("track_id", "pos", F.coalesce(text.squash("word"), F.lit("")).alias("w"))
    found = keyed.groupBy("track_id").applyInPandasWithState(
        step, "track_id long, at array<long>, kind string, spelling string", "places array<long>, words array<string>", "append",
        GroupStateTimeout.NoTimeout,
    )
    if lexicon is not None:
        terms = detect.exact_terms(lexicon).select(F.col("term").alias("spelling"), F.lit(True).alias("known")).distinct()
        terms = terms.filter(~F.col("spelling").isin(*allowlist)) if allowlist else terms
        found = found.join(terms, "spelling", "left").filter(F.col("known") | (F.col("kind") != "joined"))
    return found.select("track_id", F.explode("at").alias("pos"), "kind")


def stream_counters(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """S3: events per user, type and window under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id", "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("window.start").alias("window_start"), "user_id", "event_type", "n", "total")


def stream_sliding_counters(
    events: DataFrame, width_s: int = 86_400, slide_s: int = 21_600, late: str = "1 hour", path: str | None = None
) -> DataFrame:
    """S3 over sliding windows of `width_s` seconds that start every `slide_s` seconds (counted from 1970).

    The stream counts panes, as wide as the greatest common divisor of both, so an event is counted once and the state holds one row per
    pane, however many windows overlap. A batch writes the panes that it changed, whatever came before it; windows are sums of panes, made when the table is read.
    Where windows leave gaps between them (`slide_s` above `width_s`), panes in a gap count for none.
    """
    if min(width_s, slide_s) < 1:
        raise ValueError("width and slide are whole seconds, 1 at least")
    pane = math.gcd(width_s, slide_s)
    rows = run_to_table(stream_counters(events, f"{pane} seconds", late), "update", path, keys=["window_start", "user_id", "event_type"])
    at = F.unix_seconds("window_start")
    last = at - F.pmod(at, F.lit(slide_s))
    least = at + pane - width_s
    first = least + F.pmod(-least, F.lit(slide_s))
    starts = F.when(first <= last, F.sequence(first, last, F.lit(slide_s).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    windows = rows.withColumn("start_s", F.explode(starts)).groupBy("start_s", "user_id", "event_type")
    return windows.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select(
        F.timestamp_seconds("start_s").alias("window_start"), "user_id", "event_type", "n", "total"
    )


def split_late(stream: DataFrame, ts: str = "ts", late_ms: int = 3_600_000, path: str | None = None) -> DataFrame:
    """All rows that arrived, with `batch` and `is_late`: what an operator under a watermark of `late_ms` would drop stays countable.

    A row is late if its time is before the watermark that the batches before its own have set: the latest time that they hold,
    minus `late_ms`. The rows of the first batch and rows without a time are not late. Only one time per batch is read back, and a
    repeated batch replaces its own rows. With a `path`, a later call goes on with the watermark where it stood.
    """
    spark = stream.sparkSession
    path = path or _folder(spark, "late")
    table, marks = f"{path}/table", f"{path}/marks"
    flagged = lambda rows, mark: rows.withColumn("is_late", F.coalesce(F.unix_micros(ts) < F.lit(mark).cast("long") - late_ms * 1000, F.lit(False)))
    latest = lambda rows: rows.agg(F.max(F.unix_micros(ts)).alias("mark"))
    shape = flagged(spark.createDataFrame([], stream.schema), None)
    shape.write.mode("ignore").parquet(f"{table}/batch=-1")
    latest(shape).write.mode("ignore").parquet(f"{marks}/batch=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        mark = spark.read.parquet(marks).filter(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
        flagged(batch, mark).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        latest(spark.read.schema(shape.schema).parquet(f"{table}/batch={batch_id}")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(sink).start().awaitTermination()
    return spark.read.parquet(table).filter("batch >= 0")


def stream_quota_gate(events: DataFrame, subscribed: DataFrame, limit: int = fixed.FREE_LIMIT) -> DataFrame:
    """(user_id, event_id, admitted): the first `limit` events of a user pass, all of a subscriber's.

    State per user is one counter. Within one query a user has a single writer, which gives the
    same guarantee as a transaction; two queries writing the same counter would not have it.
    """
    flags = subscribed.select("user_id", F.lit(True).alias("sub")).distinct()
    src = events.join(flags, "user_id", "left").select("user_id", "event_id", "ts", F.coalesce("sub", F.lit(False)).alias("sub"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted(r for pdf in batches for r in zip(pdf["ts"].tolist(), pdf["event_id"].tolist(), pdf["sub"].tolist()))
        used = state.get[0] if state.exists else 0
        out = []
        for _, event_id, sub in rows:
            admitted = sub or used < limit
            used += int(admitted)
            out.append((key[0], event_id, admitted))
        state.update((used,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "admitted"])

    return src.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, admitted boolean", "used long", "append", GroupStateTimeout.NoTimeout
    )


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stream_reconcile(subs: DataFrame, path: str | None = None, buckets: int = 256) -> DataFrame:
    """Reconciled status per customer, recomputed from the latest state of all their subscriptions.

    The subscriptions lie in `buckets` by a hash of their id. A batch writes new versions of the buckets that it touches (a later
    `seq` replaces an earlier one) and then a manifest, which names the version of each bucket; the other buckets stay as they are. What
    the last two manifests do not name is deleted, so that a repeated batch still finds what it started from.
    The answer is the batch reconciliation of what the last manifest names.
    With a `path`, table and checkpoint live below it, and a later call, with the same number of buckets, goes on from there.
    """
    spark = subs.sparkSession
    path = path or _folder(spark, "subs")
    table, manifests = f"{path}/table", f"{path}/manifests"
    place = F.pmod(F.xxhash64("sub_id"), F.lit(buckets)).cast("int")
    spark.createDataFrame([], "bucket int, version long").write.mode("ignore").parquet(f"{manifests}/batch=-1")

    def versions(before: int | None = None) -> list[tuple[int, dict[int, int]]]:
        """The manifests that are left (three at most, each of one row a bucket), by their batch."""
        rows = spark.read.parquet(manifests)
        found: dict[int, dict[int, int]] = {}
        for r in (rows if before is None else rows.filter(F.col("batch") < before)).collect():
            found.setdefault(r["batch"], {})[r["bucket"]] = r["version"]
        return sorted(found.items())

    def folder(bucket: int, version: int) -> str:
        return f"{table}/version={version}/bucket={bucket}"

    def stored(names: dict[int, int]) -> DataFrame:
        paths = [folder(b, v) for b, v in sorted(names.items())]
        return spark.read.schema(subs.schema).parquet(*paths) if paths else spark.createDataFrame([], subs.schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        earlier = versions(batch_id)
        before = earlier[-1][1] if earlier else {}
        touched = {r[0] for r in batch.select(place).distinct().collect()}
        both = batch.unionByName(stored({b: v for b, v in before.items() if b in touched}))
        rest = [c for c in both.columns if c != "sub_id"]
        latest = both.groupBy("sub_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("sub_id", "r.*")
        latest.withColumn("bucket", place).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/version={batch_id}")
        now = before | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{manifests}/batch={batch_id}")
        for number, names in earlier[:-1]:
            for b, v in names.items():
                if v not in (before.get(b), now.get(b)):
                    _delete(spark, folder(b, v))
            _delete(spark, f"{manifests}/batch={number}")

    subs.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(sink).start().awaitTermination()
    left = versions()
    return usage.reconcile_subscriptions(stored(left[-1][1] if left else {}))


def sessionize(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user that end after a gap without events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("session_start"), "n"
    )


def detect_stalled(events: DataFrame, key: str = "user_id", idle_ms: int = 600_000, late: str = "0 seconds") -> DataFrame:
    """Keys (key, last_seen_ms) silent for ten minutes of event time; the state is the last time seen."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_seen_ms": [seen]})
            return
        latest = max(int(pdf["at"].max()) for pdf in batches)
        seen = max(latest, state.get[0]) if state.exists else latest
        state.update((seen,))
        state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [], "last_seen_ms": []})

    src = events.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_millis("ts").alias("at"))
    return src.groupBy("key").applyInPandasWithState(
        step, "key long, last_seen_ms long", "seen long", "append", GroupStateTimeout.EventTimeTimeout
    )


def dedupe_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Replayed events are dropped while the watermark remembers them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
