"""G: aggregates and reports (the usage aggregates are in `usage`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiline.functions import text
from lexiline.operators import detect, reports
from lexiline.registry import fixtures as fx
from lexiline.registry.base import query


@query(
    "g1_status_counts",
    f"WITH {fx.TRACKS} SELECT CASE WHEN status IN ('transcribing', 'separating') THEN 'processing' ELSE status END AS status, count(*) AS n FROM tracks GROUP BY 1",
)
def g1(spark, sf):
    return reports.status_counts(fx.tracks(spark, sf))


@query(
    "g2_term_counts",
    f"""WITH {fx.FLAGGED} SELECT track_id, count(*) AS n_words, count(*) FILTER (WHERE is_profanity) AS n_flagged, 0::BIGINT AS n_overrides,
  round(100 * count(*) FILTER (WHERE is_profanity) / count(*), 6) AS flagged_pct FROM flagged GROUP BY track_id""",
)
def g2(spark, sf):
    """Which texts contain listed terms, and how many."""
    words = fx.mix_words(spark, sf)
    hits = detect.match_exact(detect.dictionary(words), fx.lexicon(spark), ()).select("word", F.lit(True).alias("hit"))
    flagged = words.join(hits, "word", "left").withColumn("is_profanity", F.coalesce("hit", F.lit(False)))
    return reports.term_counts(flagged)


@query(
    "g3_flags_by_source",
    f"WITH {fx.DENSE}, s AS (SELECT track_id, coalesce(detection_source, 'primary') AS source FROM dense WHERE is_profanity) SELECT track_id, source, count(*) AS n FROM s GROUP BY ROLLUP (track_id, source)",
)
def g3(spark, sf):
    return reports.flags_by_source(fx.dense_flags(spark, sf))


@query(
    "g4_word_density",
    f"""WITH {fx.MIX}, {fx.TRACKS}, n AS (SELECT track_id, count(*) AS n FROM mix WHERE pos % 5 = 0 GROUP BY ALL)
SELECT track_id, duration_ms, coalesce(n, 0) AS n_words, round(coalesce(n, 0) / greatest(duration_ms / 1000, 1.0), 6) AS density, coalesce(n, 0) / greatest(duration_ms / 1000, 1.0) < 0.5 AS sparse FROM tracks LEFT JOIN n USING (track_id)""",
)
def g4(spark, sf):
    """Density of a pass that kept every fifth word."""
    words = fx.mix_words(spark, sf).filter("pos % 5 = 0")
    return reports.word_density(words, fx.tracks(spark, sf)).withColumn("density", F.round("density", 6))


LANG = """d AS (SELECT doc_id, text, CASE doc_id % 7 WHEN 0 THEN 'km' WHEN 1 THEN 'ko' WHEN 6 THEN NULL ELSE lang END AS detected, (doc_id * 37 % 100) / 100.0::DOUBLE AS p,
  (doc_id % 10) / 20.0::DOUBLE AS p_en, (doc_id % 9) / 20.0::DOUBLE AS p_es, (doc_id % 4) / 9.0::DOUBLE AS p_fr FROM documents),
l AS (SELECT *, regexp_replace(text, '[^\\p{L}]', '', 'g') AS ls FROM d), r AS (SELECT *, detected IN ('km', 'ko') AND doc_id % 3 <> 0 AND length(ls) > 0 AND
  length(regexp_replace(ls, '[^\\x{0}-\\x{24F}]', '', 'g')) / length(ls) >= 0.85 AS script FROM l),
c AS (SELECT doc_id, CASE WHEN detected IS NULL THEN 'error_fallback' WHEN script THEN 'lyrics_script_override' WHEN p >= 0.6 THEN 'detector' ELSE 'low_confidence_fallback' END AS src,
  p, p_en, p_es, p_fr, detected, CASE WHEN p_en >= p_es AND p_en >= p_fr THEN 'en' WHEN p_es >= p_fr THEN 'es' ELSE 'fr' END AS latin FROM r),
o AS (SELECT *, CASE src WHEN 'error_fallback' THEN 'en' WHEN 'lyrics_script_override' THEN latin WHEN 'detector' THEN detected ELSE CASE WHEN p_es > p_en THEN 'es' ELSE 'en' END END AS language FROM c)"""


@query(
    "g5_choose_language",
    f"""WITH {LANG} SELECT doc_id, language, CASE src WHEN 'error_fallback' THEN 0.0 WHEN 'detector' THEN p ELSE CASE language WHEN 'en' THEN p_en WHEN 'es' THEN p_es WHEN 'fr' THEN p_fr END END AS language_probability,
  src AS language_source, src <> 'detector' AS language_low_confidence FROM o""",
)
def g5(spark, sf):
    """Detector outputs made up from the document ids, next to the real texts."""
    k = F.col("doc_id")
    detected = F.when(k % 7 == 0, "km").when(k % 7 == 1, "ko").when(k % 7 != 6, F.col("lang"))
    probs = F.create_map(F.lit("en"), k % 10 / 20.0, F.lit("es"), k % 9 / 20.0, F.lit("fr"), k % 4 / 9.0)
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", detected.alias("detected"), (k * 37 % 100 / 100.0).alias("probability"), probs.alias("probs"),
        F.when(k % 3 != 0, F.col("text")).alias("ref_text"),
    )
    out = reports.choose_language(docs)
    return out.select("doc_id", "language", "language_probability", "language_source", "language_low_confidence")


@query(
    "g14_edit_signature",
    f"""WITH {fx.DENSE}, {fx.TRACKS} SELECT track_id, count(*) AS n_flagged,
  sum(('0x' || substr(md5(word || ':' || start_ms || ':' || end_ms || ':' || coalesce(censor_type, default_censor_type)), 1, 15))::BIGINT)::VARCHAR AS signature
FROM dense JOIN tracks USING (track_id) WHERE is_profanity GROUP BY track_id""",
)
def g14(spark, sf):
    return reports.edit_signature(fx.dense_flags(spark, sf), fx.tracks(spark, sf))


@query(
    "g14_edit_signature_text",
    f"""WITH {fx.DENSE}, {fx.TRACKS} SELECT track_id, string_agg(word || ':' || start_ms || ':' || end_ms || ':' || coalesce(censor_type, default_censor_type), '|' ORDER BY start_ms, pos) AS signature
FROM dense JOIN tracks USING (track_id) WHERE is_profanity GROUP BY track_id""",
)
def g14_text(spark, sf):
    return reports.edit_signature_text(fx.dense_flags(spark, sf), fx.tracks(spark, sf))


@query(
    "g15_accuracy_report",
    f"""WITH {fx.FLAGGED}, a AS (SELECT track_id, count(*) AS words_after, count(*) FILTER (WHERE pos % 10 = 3) AS corrections, count(*) FILTER (WHERE pos % 10 = 4) AS inserts,
  count(*) FILTER (WHERE is_profanity OR pos % 10 = 5) AS flags_after FROM flagged WHERE pos % 50 <> 0 GROUP BY ALL),
b AS (SELECT track_id, count(*) AS words_before, count(*) FILTER (WHERE is_profanity) AS flags_before FROM flagged GROUP BY ALL)
SELECT track_id, words_before, flags_before, coalesce(words_after, 0) AS words_after, coalesce(corrections, 0) AS corrections, coalesce(inserts, 0) AS inserts, coalesce(flags_after, 0) AS flags_after,
  coalesce(flags_after, 0) - flags_before AS flags_added FROM b LEFT JOIN a USING (track_id)""",
)
def g15(spark, sf):
    before = fx.flagged_words(spark, sf)
    after = (
        before.filter("pos % 50 <> 0")
        .withColumn("original_word", F.when(F.col("pos") % 10 == 3, F.col("word")))
        .withColumn("detection_source", F.when(F.col("pos") % 10 == 4, "lyrics_gap"))
        .withColumn("is_profanity", F.col("is_profanity") | (F.col("pos") % 10 == 5))
    )
    return reports.accuracy_report(before, after)


@query(
    "g16_detection_quality",
    f"""WITH {fx.FLAGGED}, h AS (SELECT DISTINCT track_id AS doc_id FROM flagged WHERE is_profanity), j AS (SELECT toxic = 1 AS t, h.doc_id IS NOT NULL AS p FROM labels LEFT JOIN h USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn, count(*) FILTER (WHERE NOT p AND NOT t) AS tn FROM j)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c""",
)
def g16(spark, sf):
    """Listed terms as a predictor of the toxic label."""
    hits = fx.mix_words(spark, sf).filter(text.squash("word").isin(*fx.TERMS)).select(F.col("track_id").alias("doc_id"))
    return reports.detection_quality(hits, fx.table(spark, sf, "labels"))


@query(
    "g17_latency_summary",
    """WITH m AS (SELECT user_id, event_type, median(value) AS med FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)
SELECT user_id, max(med) FILTER (WHERE event_type = 'view') AS median_base, max(med) FILTER (WHERE event_type = 'click') AS median_other,
  CASE WHEN max(med) FILTER (WHERE event_type = 'click') > 0 THEN round(max(med) FILTER (WHERE event_type = 'view') / max(med) FILTER (WHERE event_type = 'click'), 6) END AS speedup FROM m GROUP BY user_id""",
)
def g17(spark, sf):
    """Views and clicks of a user play two run modes."""
    return reports.latency_summary(fx.table(spark, sf, "events"), ["user_id"], "event_type", "value", "view", "click", 1.0)
