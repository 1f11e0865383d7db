"""Joins on time: every one is an equi join on (track, time bucket) plus an exact residual test.

The bucket is part of the join key, so a track with very many rows spreads over many tasks, and a
row only meets rows of its own stretch of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKET_MS = 5000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def buckets(lo, hi, width: int = BUCKET_MS) -> Column:
    """All buckets an interval touches; none when it is inverted."""
    lo, hi = F.floor(_c(lo) / width), F.floor(_c(hi) / width)
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple,
    right_span: tuple,
    on: Column | None = None,
    key: str = "track_id",
    width: int = BUCKET_MS,
) -> DataFrame:
    """Pairs whose closed intervals meet. `right` must not share column names except the key.

    Both sides are copied into the buckets they touch; a pair is kept in the first common bucket. The borders are
    derived again after the join, so the copies carry nothing but their own columns and the bucket.
    """
    l0, l1, r0, r1 = (_c(c) for c in (*left_span, *right_span))
    l = left.withColumn("__b", F.explode(buckets(l0, l1, width)))
    r = right.withColumn("__b", F.explode(buckets(r0, r1, width)))
    meets = (l0 <= r1) & (r0 <= l1) & (F.col("__b") == F.floor(F.greatest(l0, r0) / width))
    return l.join(r, [key, "__b"]).filter(meets if on is None else meets & on).drop("__b")


def without_overlap(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple,
    right_span: tuple,
    row_key: list[str],
    on: Column | None = None,
    key: str = "track_id",
    width: int = BUCKET_MS,
) -> DataFrame:
    """Rows of `left` (identified by `row_key`) that no interval of `right` meets."""
    slim = left.select(*row_key, *[_c(c).alias(f"__l{i}") for i, c in enumerate(left_span)])
    hits = overlap_pairs(slim, right, ("__l0", "__l1"), right_span, on, key, width).select(*row_key).distinct()
    return left.join(hits, row_key, "left_anti")


def active_word_at(times: DataFrame, words: DataFrame, time_col: str = "t_ms") -> DataFrame:
    """Point in interval: the word with start <= t < end, null where there is none.

    `times` needs a row id column `time_id`. Among overlapping words the first in order counts.
    """
    span = words.select("track_id", "word_id", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    t = times.select("track_id", "time_id", F.col(time_col).alias("__t"))
    inside = F.col("__t") < F.col("__e")
    pairs = overlap_pairs(t, span, ("__t", "__t"), ("__s", "__e"), inside)
    best = pairs.groupBy("track_id", "time_id").agg(F.min_by("word_id", F.struct("__s", "__e", "word_id")).alias("word_id"))
    return times.join(best, ["track_id", "time_id"], "left")


def slot_occupants(slots: DataFrame, words: DataFrame, margin_ms: int = 100) -> DataFrame:
    """Words that overlap a slot (with a margin) and do not belong to the run that produced it.

    `slots` has (track_id, slot_id, slot_start_ms, slot_end_ms, run_from, run_to); the run is a range
    of word positions.
    """
    w = words.select("track_id", "pos", "word", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    strict = (
        (F.col("w_start") < F.col("slot_end_ms") + margin_ms)
        & (F.col("w_end") > F.col("slot_start_ms") - margin_ms)
        & ~F.col("pos").between(F.col("run_from"), F.col("run_to"))
    )
    span = (F.col("slot_start_ms") - margin_ms, F.col("slot_end_ms") + margin_ms)
    return overlap_pairs(slots, w, span, ("w_start", "w_end"), strict)


def merge_passes(
    primary: DataFrame, secondary: DataFrame, import_all: bool | DataFrame = False, near_ms: int = 300
) -> DataFrame:
    """Merge a second detection pass into the first.

    A flagged second-pass word is absorbed by the first primary word that it overlaps with equal text
    or that is flagged already, or that has equal text within 0.3 s: the primary takes flag and timing,
    source `vocals`. Otherwise it is added, source `adlib`. Clean second-pass words are added (source
    `vocals_fill`) only for tracks in `import_all`, where nothing overlaps or repeats them.

    Second-pass words that no primary absorbs are then compared with one another by the same rule: a word that repeats
    an earlier one goes, and an earlier one that stays takes flag and timing, source `vocals`.

    The rule looks at the words as they came, so the result does not depend on processing order; of several words
    absorbed by one the last gives the timing.
    """
    if isinstance(import_all, bool):
        sec = secondary if import_all else secondary.filter("is_profanity")
    else:
        sparse = import_all.select("track_id").distinct().withColumn("__all", F.lit(True))
        sec = secondary.join(sparse, "track_id", "left").filter(F.col("is_profanity") | F.col("__all")).drop("__all")
    s = sec.select(
        "track_id",
        F.col("word_id").alias("s_id"),
        F.lower("word").alias("s_word"),
        F.col("start_ms").alias("s_start"),
        F.col("end_ms").alias("s_end"),
        F.col("is_profanity").alias("s_flag"),
    )
    p = primary.select(
        "track_id",
        F.col("word_id").alias("p_id"),
        F.lower("word").alias("p_word"),
        F.col("start_ms").alias("p_start"),
        F.col("end_ms").alias("p_end"),
        F.coalesce("is_profanity", F.lit(False)).alias("p_flag"),
    )
    pairs = _repeats(s, p, near_ms)
    chosen = pairs.groupBy("track_id", "s_id").agg(
        F.min_by(F.struct("p_id", "s_start", "s_end", "s_flag"), F.struct("p_start", "p_end", "p_id")).alias("c")
    )
    taken = (
        chosen.filter("c.s_flag")
        .groupBy("track_id", F.col("c.p_id").alias("word_id"))
        .agg(F.max_by(F.struct("c.s_start", "c.s_end"), F.struct("c.s_start", "c.s_end", "s_id")).alias("__v"))
    )
    merged = _retimed(primary, taken)
    absorbed = chosen.select("track_id", F.col("s_id").alias("word_id"))
    added = sec.join(absorbed, ["track_id", "word_id"], "left_anti")
    late = s.join(added.select("track_id", F.col("word_id").alias("s_id")), ["track_id", "s_id"], "left_semi")
    early = late.select("track_id", *[F.col(f"s_{c}").alias(f"p_{c}") for c in ("id", "word", "start", "end", "flag")])
    after = F.struct("p_start", "p_end", "p_id") < F.struct("s_start", "s_end", "s_id")
    again = _repeats(late, early, near_ms, after)
    retaken = (
        again.filter("s_flag")
        .groupBy("track_id", F.col("p_id").alias("word_id"))
        .agg(F.max_by(F.struct("s_start", "s_end"), F.struct("s_start", "s_end", "s_id")).alias("__v"))
    )
    source = F.when(F.col("is_profanity"), "adlib").otherwise("vocals_fill")
    firsts = added.join(again.select("track_id", F.col("s_id").alias("word_id")).distinct(), ["track_id", "word_id"], "left_anti")
    return merged.unionByName(_retimed(firsts.withColumn("detection_source", source), retaken), allowMissingColumns=True)


def _repeats(later: DataFrame, earlier: DataFrame, near_ms: int, also=None) -> DataFrame:
    """Pairs of a second-pass word (s_*) and a word that absorbs it (p_*)."""
    overlap = F.least("s_end", "p_end") > F.greatest("s_start", "p_start")
    gap = F.least(F.abs(F.col("s_start") - F.col("p_end")), F.abs(F.col("p_start") - F.col("s_end")))
    same = F.trim("s_word") == F.trim("p_word")
    near = (gap < near_ms) & (F.col("s_word") == F.col("p_word"))
    hit = F.when(F.col("s_flag"), (overlap & (same | F.col("p_flag"))) | near).otherwise(overlap | near)
    reach = (F.col("p_start") - near_ms, F.col("p_end") + near_ms)
    return overlap_pairs(later, earlier, ("s_start", "s_end"), reach, hit if also is None else hit & also)


def _retimed(words: DataFrame, taken: DataFrame) -> DataFrame:
    """Words with flag, timing and source of what they absorbed: `taken` (track_id, word_id, __v)."""
    got = F.col("__v").isNotNull()
    return (
        words.join(taken, ["track_id", "word_id"], "left")
        .withColumn("start_ms", F.coalesce("__v.s_start", "start_ms"))
        .withColumn("end_ms", F.coalesce("__v.s_end", "end_ms"))
        .withColumn("is_profanity", got | F.coalesce("is_profanity", F.lit(False)))
        .withColumn("detection_source", F.when(got, "vocals").otherwise(F.col("detection_source")))
        .drop("__v")
    )
