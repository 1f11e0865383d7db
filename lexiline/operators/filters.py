"""Row filters and simple projections on word timelines, lines, events and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiline import fixed
from lexiline.functions import text
from lexiline.operators import blocks

MAX_WORD_MS = 2000


def drop_symbol_tokens(words: DataFrame, col: str = "word") -> DataFrame:
    """Keep tokens with a letter or digit, and runs of at least three asterisks."""
    c = F.col(col)
    return words.filter(c.rlike(r"[\p{L}\p{N}]") | c.rlike(r"^\*{3,}$"))


def confidence_floor(words: DataFrame, floor: float = 0.15) -> DataFrame:
    """Second-pass floor; a missing confidence counts as 1."""
    return words.filter(F.coalesce("confidence", F.lit(1.0)) >= floor)


def rescan_floor(words: DataFrame, hits: DataFrame, clean: float = 0.30, flagged: float = 0.15) -> DataFrame:
    """Recovered words: floor 0.30, or 0.15 where the token is a lexicon hit (`hits.word`)."""
    marked = words.join(hits.select("word", F.lit(True).alias("__hit")), "word", "left")
    floor = F.when(F.col("__hit"), flagged).otherwise(clean)
    return marked.filter(F.col("confidence") >= floor).drop("__hit")


def strip_low_conf_prefix(words: DataFrame, min_conf: float = 0.5, n: int = 3) -> DataFrame:
    """Drop the words before the first confident one when there are at least `n` of them.

    A missing confidence counts as 0. Tracks without a confident word are kept whole. Both facts
    per track come from aggregates, so a long track is never ordered in one task.
    """
    order = F.struct("start_ms", "end_ms", "word_id")
    confident = F.coalesce("confidence", F.lit(0.0)) >= min_conf
    first = words.filter(confident).groupBy("track_id").agg(F.min(order).alias("__first"))
    marked = words.join(first, "track_id", "left")
    before = order < F.col("__first")
    counts = marked.filter(before).groupBy("track_id").agg(F.count("*").alias("__n"))
    cut = first.join(counts, "track_id").filter(F.col("__n") >= n).select("track_id", "__first")
    kept = words.join(cut, "track_id", "left")
    return kept.filter(F.col("__first").isNull() | (order >= F.col("__first"))).drop("__first")


def clamp_durations(words: DataFrame, max_ms: int = MAX_WORD_MS) -> DataFrame:
    """Unflagged words longer than the limit end at start + limit; flagged words are exempt."""
    too_long = (F.col("end_ms") - F.col("start_ms") > max_ms) & ~F.coalesce("is_profanity", F.lit(False))
    return words.withColumn("end_ms", F.when(too_long, F.col("start_ms") + max_ms).otherwise(F.col("end_ms")))


def max_duration(words: DataFrame, max_ms: int = MAX_WORD_MS) -> DataFrame:
    return words.filter(F.col("end_ms") - F.col("start_ms") <= max_ms)


def clip_lines(lines: DataFrame, words: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Keep lines from one second before the first word to five seconds past the track's end."""
    first = words.groupBy("track_id").agg(F.min("start_ms").alias("__first"))
    kept = lines.join(first, "track_id").filter(F.col("time_ms") >= F.col("__first") - 1000).drop("__first")
    if tracks is None:
        return kept
    ends = tracks.select("track_id", F.col("duration_ms").alias("__dur"))
    kept = kept.join(ends, "track_id", "left")
    return kept.filter(F.col("__dur").isNull() | (F.col("time_ms") <= F.col("__dur") + 5000)).drop("__dur")


def valid_manual_words(words: DataFrame, tracks: DataFrame) -> DataFrame:
    """User-added words: text not blank, end > start >= 0, end at most half a second past the track."""
    ends = tracks.select("track_id", F.col("duration_ms").alias("__dur"))
    ok = (
        (F.trim("word") != "")
        & (F.col("start_ms") >= 0)
        & (F.col("end_ms") > F.col("start_ms"))
        & (F.col("end_ms") <= F.col("__dur") + 500)
    )
    return words.join(ends, "track_id").filter(ok).drop("__dur")


def is_valid_metric() -> Column:
    return F.coalesce(F.col("field").isin(*fixed.METRIC_FIELDS) & (F.col("count") >= 1), F.lit(False))


def valid_metric_events(events: DataFrame) -> DataFrame:
    """Events with an allowed field and a count of at least one."""
    return events.filter(is_valid_metric())


def rejected_metric_events(events: DataFrame) -> DataFrame:
    """The complement of `valid_metric_events`, with the reason."""
    reason = F.when(
        ~F.coalesce(F.col("field").isin(*fixed.METRIC_FIELDS), F.lit(False)), "invalid_field"
    ).otherwise("invalid_count")
    return events.filter(~is_valid_metric()).withColumn("reason", reason)


def valid_feedback(messages: DataFrame, col: str = "message") -> DataFrame:
    """Messages that are not blank, trimmed."""
    return messages.filter(F.coalesce(text.trim_ws(col), F.lit("")) != "").withColumn(col, text.trim_ws(col))


def exportable_tracks(tracks: DataFrame, words: DataFrame) -> DataFrame:
    """Ready or completed tracks with at least one flagged word."""
    flagged = words.filter("is_profanity").select("track_id").distinct()
    return tracks.filter(F.col("status").isin("ready", "completed")).join(flagged, "track_id", "left_semi")


def retention(df: DataFrame, ts: str, now, ttl: str, newest_per: str | None = None, tie: str | None = None) -> DataFrame:
    """Rows younger than the time to live; optionally only the newest per source.

    The newest row is a struct maximum, so each source is combined before the shuffle.
    """
    at = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    fresh = df.filter(F.col(ts) >= at - F.expr(f"INTERVAL {ttl}"))
    if newest_per is None:
        return fresh
    order = F.struct(*[F.col(c) for c in (ts, tie) if c])
    rest = F.struct(*[F.col(c) for c in df.columns if c != newest_per])
    return fresh.groupBy(newest_per).agg(F.max_by(rest, order).alias("__r")).select(newest_per, "__r.*").select(*df.columns)


def uncovered_words(recovered: DataFrame, known: DataFrame, hits: DataFrame, margin_ms: int = 100, bucket_ms: int = 5000) -> DataFrame:
    """Drop recovered words whose midpoint lies inside a known word (with a margin), except lexicon hits.

    The interval test is an equi join on (track, time bucket): known words are copied into each
    bucket they touch, a midpoint falls into exactly one.
    """
    lo = F.col("start_ms") - margin_ms
    hi = F.col("end_ms") + margin_ms
    spans = known.select(
        "track_id",
        lo.alias("__lo"),
        hi.alias("__hi"),
        F.explode(F.sequence(F.floor(lo / bucket_ms), F.floor(hi / bucket_ms))).alias("__b"),
    )
    mid2 = F.col("start_ms") + F.col("end_ms")
    marked = recovered.join(hits.select("word", F.lit(True).alias("__hit")), "word", "left")
    marked = marked.withColumn("__mid2", mid2).withColumn("__b", F.floor(mid2 / 2 / bucket_ms))
    inside = (F.col("__mid2") >= 2 * F.col("__lo")) & (F.col("__mid2") <= 2 * F.col("__hi"))
    spans = spans.withColumnRenamed("track_id", "__t").withColumnRenamed("__b", "__kb")
    cond = (F.col("track_id") == F.col("__t")) & (F.col("__b") == F.col("__kb")) & inside & F.col("__hit").isNull()
    return marked.join(spans, cond, "left_anti").select(*recovered.columns)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First `k` rows per key; Spark limits each partition before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def quota_cut(tracks: DataFrame, entitlements: DataFrame) -> DataFrame:
    """The first `remaining` tracks of each user in order; all of them for -1 (unlimited).

    The position in the user's list comes from `blocks.dense_pos`, so one busy user is not one task.
    """
    numbered = blocks.dense_pos(tracks, ["uid"], ["track_id"], "__pos", width=100_000)
    joined = numbered.join(entitlements.select("uid", "remaining"), "uid")
    ok = (F.col("remaining") < 0) | (F.col("__pos") < F.col("remaining"))
    return joined.filter(ok).select(*tracks.columns)
