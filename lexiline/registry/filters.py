"""C: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiline.functions import text
from lexiline.operators import filters
from lexiline.registry import fixtures as fx
from lexiline.registry.base import query
from lexiline.registry.text import BLANKS

KEY = ["track_id", "pos"]


@query(
    "c1_drop_symbol_tokens",
    f"WITH {fx.MIX} SELECT track_id, pos, word FROM mix WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]') OR regexp_full_match(word, '\\*{{3,}}')",
)
def c1(spark, sf):
    return filters.drop_symbol_tokens(fx.mix_words(spark, sf)).select("track_id", "pos", "word")


HITS_SQL = f"""WITH {fx.FLAGGED}{fx.STEM}
SELECT 'second' AS rule, track_id, pos FROM stem WHERE confidence >= 0.15
UNION ALL SELECT 'rescan', track_id, pos FROM stem WHERE confidence >= CASE WHEN is_profanity THEN 0.15 ELSE 0.30 END"""


@query("c2_confidence_floor", HITS_SQL)
def c2(spark, sf):
    """Second-pass floor and the two-level floor of recovered words."""
    stem = fx.stem_words(spark, sf)
    hits = stem.filter(text.squash("word").isin(*fx.TERMS)).select("word").distinct()
    second = filters.confidence_floor(stem).select(F.lit("second").alias("rule"), *KEY)
    return second.unionByName(filters.rescan_floor(stem, hits).select(F.lit("rescan").alias("rule"), *KEY))


STRIP_SQL = f"""WITH {fx.MIX}, f AS (SELECT *, min(CASE WHEN confidence >= 0.5 THEN pos END) OVER (PARTITION BY track_id) AS first FROM mix)
SELECT track_id, pos FROM f WHERE first IS NULL OR first < 3 OR pos >= first"""


@query("c3_strip_low_conf_prefix", STRIP_SQL)
def c3(spark, sf):
    return filters.strip_low_conf_prefix(fx.mix_words(spark, sf)).select(*KEY)


def _long_words(spark, sf):
    w = fx.flagged_words(spark, sf)
    return w.withColumn("end_ms", F.col("start_ms") + F.when(F.col("pos") % 50 == 0, 5260).when(F.col("pos") % 50 == 1, 2000).otherwise(300))


LONG = fx.FLAGGED + """, long AS (SELECT track_id, pos, start_ms, start_ms + CASE WHEN pos % 50 = 0 THEN 5260 WHEN pos % 50 = 1 THEN 2000 ELSE 300 END AS end_ms,
  is_profanity FROM flagged)"""


@query(
    "c4_clamp_durations",
    f"WITH {LONG} SELECT track_id, pos, CASE WHEN end_ms - start_ms > 2000 AND NOT is_profanity THEN start_ms + 2000 ELSE end_ms END AS end_ms FROM long",
)
def c4(spark, sf):
    return filters.clamp_durations(_long_words(spark, sf)).select(*KEY, "end_ms")


@query("c5_max_duration", f"WITH {LONG} SELECT track_id, pos FROM long WHERE end_ms - start_ms <= 2000")
def c5(spark, sf):
    return filters.max_duration(_long_words(spark, sf)).select(*KEY)


@query(
    "c6_clip_lines",
    f"""WITH {fx.MIX}, {fx.LINES}, {fx.TRACKS}, first AS (SELECT track_id, min(start_ms) AS f FROM mix WHERE pos >= 10 GROUP BY track_id)
SELECT track_id, line_no FROM lines JOIN first USING (track_id) JOIN tracks USING (track_id)
WHERE time_ms >= f - 1000 AND time_ms <= duration_ms * 3 // 4 + 5000""",
)
def c6(spark, sf):
    """Lines against words from the eleventh on, on tracks cut to three quarters."""
    words = fx.mix_words(spark, sf).filter("pos >= 10")
    tr = fx.tracks(spark, sf).withColumn("duration_ms", F.floor(F.col("duration_ms") * 3 / 4))
    return filters.clip_lines(fx.timed_lines(spark, sf), words, tr).select("track_id", "line_no")


@query(
    "c7_looks_like_lyrics",
    f"""WITH l AS (SELECT doc_id, list_filter(string_split(trim(text, {BLANKS}), chr(10)), lambda x: trim(x, {BLANKS}) <> '') AS ls FROM documents)
SELECT doc_id, len(ls) > 0 AND list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) <= 120
  AND len(list_filter(ls, lambda x: length(trim(x, {BLANKS})) < 80))::DOUBLE / len(ls) >= 0.5 AS is_lyrics FROM l""",
)
def c7(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.looks_like_lyrics("text").alias("is_lyrics"))


UNCOVERED_SQL = f"""WITH {fx.FLAGGED}{fx.STEM}, known AS (SELECT * FROM flagged WHERE pos % 10 <> 0)
SELECT track_id, pos FROM stem s WHERE is_profanity OR NOT EXISTS (SELECT 1 FROM known k WHERE k.track_id = s.track_id
  AND s.start_ms + s.end_ms >= 2 * (k.start_ms - 100) AND s.start_ms + s.end_ms <= 2 * (k.end_ms + 100))"""


@query("c8_uncovered_words", UNCOVERED_SQL)
def c8(spark, sf):
    """Second-pass words against a first pass with every tenth word missing."""
    stem = fx.stem_words(spark, sf)
    known = fx.mix_words(spark, sf).filter("pos % 10 <> 0")
    hits = stem.filter("is_profanity").select("word").distinct()
    return filters.uncovered_words(stem, known, hits).select(*KEY)


@query(
    "c9_valid_manual_words",
    f"""WITH {fx.MIX}, {fx.TRACKS}, m AS (SELECT track_id, pos, CASE WHEN pos % 13 = 0 THEN '  ' ELSE word END AS word, start_ms - 400 AS start_ms,
  CASE WHEN pos % 17 = 0 THEN start_ms - 500 ELSE end_ms + 700 END AS end_ms FROM mix)
SELECT track_id, pos FROM m JOIN tracks USING (track_id) WHERE trim(word) <> '' AND start_ms >= 0 AND end_ms > start_ms AND end_ms <= duration_ms + 500""",
)
def c9(spark, sf):
    w = fx.mix_words(spark, sf)
    w = w.withColumn("word", F.when(F.col("pos") % 13 == 0, "  ").otherwise(F.col("word")))
    w = w.withColumn("end_ms", F.when(F.col("pos") % 17 == 0, F.col("start_ms") - 500).otherwise(F.col("end_ms") + 700))
    w = w.withColumn("start_ms", F.col("start_ms") - 400)
    return filters.valid_manual_words(w, fx.tracks(spark, sf)).select(*KEY)


def metric_events(spark, sf):
    field = F.when(F.col("event_type") == "view", "songsImported").when(F.col("event_type") == "click", "songsReady").otherwise(F.col("event_type"))
    return fx.table(spark, sf, "events").select("event_id", "user_id", field.alias("field"), F.floor("value").alias("count"))


METRIC = """metric AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'songsImported' WHEN 'click' THEN 'songsReady' ELSE event_type END AS field,
  floor(value)::BIGINT AS count FROM events)"""


@query(
    "c10_metric_events",
    f"""WITH {METRIC} SELECT event_id, CASE WHEN field NOT IN ('songsImported', 'songsReady') THEN 'invalid_field' WHEN count >= 1 THEN 'valid' ELSE 'invalid_count' END AS verdict FROM metric""",
)
def c10(spark, sf):
    """Accepted events and the rejected ones with their reason."""
    ev = metric_events(spark, sf)
    good = filters.valid_metric_events(ev).select("event_id", F.lit("valid").alias("verdict"))
    return good.unionByName(filters.rejected_metric_events(ev).select("event_id", F.col("reason").alias("verdict")))


@query(
    "c10_valid_feedback",
    f"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' ' || chr(10) ELSE '  ' || text || ' ' END AS message FROM conversations)
SELECT conv_id, turn, trim(message, {BLANKS}) AS message FROM m WHERE trim(message, {BLANKS}) <> ''""",
)
def c10b(spark, sf):
    msg = F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.concat(F.lit("  "), "text", F.lit(" ")))
    conv = fx.table(spark, sf, "conversations").select("conv_id", "turn", msg.alias("message"))
    return filters.valid_feedback(conv)


@query(
    "c11_exportable_tracks",
    f"WITH {fx.FLAGGED}, {fx.TRACKS} SELECT track_id, status FROM tracks WHERE status IN ('ready', 'completed') AND track_id IN (SELECT track_id FROM flagged WHERE is_profanity)",
)
def c11(spark, sf):
    return filters.exportable_tracks(fx.tracks(spark, sf), fx.flagged_words(spark, sf)).select("track_id", "status")


RETENTION_SQL = """WITH f AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)
SELECT 'cache' AS rule, event_id FROM f UNION ALL
SELECT 'newest', event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM f) WHERE rn = 1"""


@query("c12_retention", RETENTION_SQL)
def c12(spark, sf):
    """Events of the last ten days, and the newest one per user."""
    ev = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = "2024-01-31 00:00:00"
    cache = filters.retention(ev, "ts", now, "10 DAYS").select(F.lit("cache").alias("rule"), "event_id")
    newest = filters.retention(ev, "ts", now, "10 DAYS", "user_id", "event_id")
    return cache.unionByName(newest.select(F.lit("newest").alias("rule"), "event_id"))
