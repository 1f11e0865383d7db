"""E1, E5, E15 and H: timelines, intervals, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiline.operators import evidence, filters, intervals, reports, timeline
from lexiline.registry import fixtures as fx
from lexiline.registry.base import query


@query("e1_estimate_line_words", f"WITH {fx.LINE_WORDS} SELECT track_id, line_no, word_no, raw, word, start_ms, end_ms FROM lineword")
def e1(spark, sf):
    out = evidence.estimate_line_words(fx.timed_lines(spark, sf))
    return out.select("track_id", "line_no", "word_no", "raw", "word", "start_ms", "end_ms")


def merge_sql(import_all: bool) -> str:
    source = "stem WHERE confidence >= 0.15" + ("" if import_all else " AND is_profanity")
    return f"""WITH {fx.OVERLAP}{fx.STEM}, pri AS (SELECT * FROM overlap WHERE pos % 10 <> 0), sec AS (SELECT * FROM {source}),
h AS (SELECT s.track_id, s.pos AS s_id, s.start_ms AS ss, s.end_ms AS se, s.is_profanity AS sf, p.pos AS p_id, p.start_ms AS ps, p.end_ms AS pe
  FROM sec s JOIN pri p ON s.track_id = p.track_id AND CASE WHEN s.is_profanity
    THEN (least(s.end_ms, p.end_ms) > greatest(s.start_ms, p.start_ms) AND (trim(lower(s.word)) = trim(lower(p.word)) OR p.is_profanity))
      OR (least(abs(s.start_ms - p.end_ms), abs(p.start_ms - s.end_ms)) < 300 AND lower(s.word) = lower(p.word))
    ELSE least(s.end_ms, p.end_ms) > greatest(s.start_ms, p.start_ms)
      OR (least(abs(s.start_ms - p.end_ms), abs(p.start_ms - s.end_ms)) < 300 AND lower(s.word) = lower(p.word)) END),
c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY track_id, s_id ORDER BY ps, pe, p_id) = 1),
t AS (SELECT * FROM c WHERE sf QUALIFY row_number() OVER (PARTITION BY track_id, p_id ORDER BY ss DESC, se DESC, s_id DESC) = 1),
r AS (SELECT * FROM sec s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.track_id = s.track_id AND c.s_id = s.pos)),
d AS (SELECT a.track_id, a.pos AS e_id, b.pos AS l_id, b.start_ms AS ls, b.end_ms AS le, b.is_profanity AS lf
  FROM r a JOIN r b ON a.track_id = b.track_id AND (a.start_ms, a.end_ms, a.pos) < (b.start_ms, b.end_ms, b.pos) AND CASE WHEN b.is_profanity
    THEN (least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) AND (trim(lower(a.word)) = trim(lower(b.word)) OR a.is_profanity))
      OR (least(abs(a.start_ms - b.end_ms), abs(b.start_ms - a.end_ms)) < 300 AND lower(a.word) = lower(b.word))
    ELSE least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms)
      OR (least(abs(a.start_ms - b.end_ms), abs(b.start_ms - a.end_ms)) < 300 AND lower(a.word) = lower(b.word)) END),
u AS (SELECT * FROM d WHERE lf QUALIFY row_number() OVER (PARTITION BY track_id, e_id ORDER BY ls DESC, le DESC, l_id DESC) = 1)
SELECT p.track_id, p.word, coalesce(t.ss, p.start_ms) AS start_ms, coalesce(t.se, p.end_ms) AS end_ms, p.is_profanity OR t.p_id IS NOT NULL AS is_profanity,
  CASE WHEN t.p_id IS NOT NULL THEN 'vocals' END AS detection_source FROM pri p LEFT JOIN t ON t.track_id = p.track_id AND t.p_id = p.pos
UNION ALL SELECT r.track_id, r.word, coalesce(u.ls, r.start_ms), coalesce(u.le, r.end_ms), r.is_profanity OR u.e_id IS NOT NULL,
  CASE WHEN u.e_id IS NOT NULL THEN 'vocals' WHEN r.is_profanity THEN 'adlib' ELSE 'vocals_fill' END
  FROM r LEFT JOIN u ON u.track_id = r.track_id AND u.e_id = r.pos WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.track_id = r.track_id AND d.l_id = r.pos)"""


def _merge(spark, sf, import_all):
    primary = fx.overlapping_words(spark, sf).filter("pos % 10 <> 0")
    secondary = filters.confidence_floor(fx.stem_words(spark, sf))
    out = intervals.merge_passes(primary, secondary, import_all)
    return out.select("track_id", "word", "start_ms", "end_ms", "is_profanity", "detection_source")


@query("e5_merge_passes", merge_sql(False))
def e5(spark, sf):
    return _merge(spark, sf, False)


@query("e5_merge_passes_all", merge_sql(True))
def e5_all(spark, sf):
    """Every second-pass word is a candidate, as for sparse tracks."""
    return _merge(spark, sf, True)


@query(
    "e15_active_word_at",
    f"""WITH {fx.OVERLAP}, q AS (SELECT event_id AS time_id, doc_id AS track_id, (event_id * 37) % 120000 AS t_ms FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)),
k AS (SELECT *, unnest([t_ms // 400, t_ms // 400 - 1]) AS pos FROM q), -- words start at 400 * pos and last 750 ms at most
m AS (SELECT k.time_id, arg_min(o.pos, (o.start_ms, o.end_ms, o.pos)) AS word_id FROM k JOIN overlap o ON o.track_id = k.track_id AND o.pos = k.pos AND o.start_ms <= t_ms AND t_ms < o.end_ms GROUP BY ALL)
SELECT q.time_id, q.track_id, q.t_ms, m.word_id FROM q LEFT JOIN m USING (time_id)""",
)
def e15(spark, sf):
    """One playback position per event, on some track."""
    docs = fx.table(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n"))
    ev = fx.table(spark, sf, "events").select(F.col("event_id").alias("time_id"), (F.col("event_id") * 37 % 120000).alias("t_ms"))
    # One counting row: the smallest table there is.
    times = ev.join(n, F.lit(True)).withColumn("track_id", F.col("time_id") % F.col("n")).drop("n")
    out = intervals.active_word_at(times, fx.overlapping_words(spark, sf))
    return out.select("time_id", "track_id", "t_ms", "word_id")


# --- H ----------------------------------------------------------------------------------


@query(
    "h2_check_timeline",
    f"""WITH {fx.OVERLAP}, o AS (SELECT track_id, pos, CASE WHEN pos % 100 = 7 THEN end_ms + 10 ELSE start_ms END AS start_ms, end_ms FROM overlap),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY pos) AS ns FROM o)
SELECT track_id, pos, 'start>end' AS kind FROM n WHERE start_ms > end_ms UNION ALL SELECT track_id, pos, 'negative start' FROM n WHERE start_ms < 0
UNION ALL SELECT track_id, pos, 'unsorted' FROM n WHERE start_ms > ns UNION ALL SELECT track_id, pos, 'overlap' FROM n WHERE end_ms > ns""",
)
def h2(spark, sf):
    """Violations of a timeline with overlaps and a few inverted words."""
    w = fx.overlapping_words(spark, sf)
    bad = F.when(F.col("pos") % 100 == 7, F.col("end_ms") + 10).otherwise(F.col("start_ms"))
    return timeline.check_timeline(w.withColumn("start_ms", bad))


def intervals_sql(censor: str, words: str = "dense") -> str:
    extra = "CASE WHEN detection_source IN ('lyrics', 'lyrics_gap', 'hook_echo', 'acoustic_echo') THEN 100 ELSE 0 END"
    whole = lambda c: f"trunc({c} / 1000.0::DOUBLE * 1000.0::DOUBLE)::BIGINT"
    return f"""iv0 AS (SELECT track_id, pos, word, start_ms, {censor} AS t, greatest(0, {whole('start_ms')} - 150 - {extra}) AS lo,
  least(duration_ms, {whole('end_ms')} + 100 + {extra}) AS hi FROM {words} JOIN tracks USING (track_id) WHERE is_profanity),
iv AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, pos) AS n FROM iv0 WHERE hi > lo)"""


SINGLE_SQL = f"""WITH {fx.DENSE}, {fx.TRACKS}, {intervals_sql("'mute'")},
m AS (SELECT *, max(hi) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR lo > b THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY n) - 1 AS region_no FROM m)
SELECT track_id, region_no::BIGINT AS region_no, arg_min(lo, n) AS start_ms, max(hi) AS end_ms, 'mute' AS censor_type, count(*) AS n_words FROM g GROUP BY track_id, region_no"""


def _with_duration(words, spark, sf):
    return words.join(fx.tracks(spark, sf).select("track_id", "duration_ms"), "track_id")


@query("h3_censor_regions", SINGLE_SQL)
def h3(spark, sf):
    w = _with_duration(fx.dense_flags(spark, sf).withColumn("censor_type", F.lit("mute")), spark, sf)
    return timeline.censor_regions(w)


# The mixed-type rule as a literal left fold, one word per recursion step.
FOLD = f"""WITH RECURSIVE {fx.DENSE}, {fx.TRACKS}, {{iv}},
st AS (SELECT track_id, n, 0::BIGINT AS region_no, lo AS rs, hi AS re, t AS rt, true AS counted FROM iv WHERE n = 1
UNION ALL SELECT i.track_id, i.n,
  CASE WHEN (i.lo <= st.re AND i.t = st.rt) OR (i.lo < st.re AND i.hi <= st.re) THEN st.region_no ELSE st.region_no + 1 END,
  CASE WHEN (i.lo <= st.re AND i.t = st.rt) OR (i.lo < st.re AND i.hi <= st.re) THEN st.rs WHEN i.lo < st.re THEN st.re ELSE i.lo END,
  CASE WHEN i.lo <= st.re AND i.t = st.rt THEN greatest(st.re, i.hi) WHEN i.lo < st.re AND i.hi <= st.re THEN st.re ELSE i.hi END,
  CASE WHEN (i.lo <= st.re AND i.t = st.rt) OR (i.lo < st.re AND i.hi <= st.re) THEN st.rt ELSE i.t END,
  NOT (i.t <> st.rt AND i.lo < st.re AND i.hi <= st.re)
  FROM st JOIN iv i ON i.track_id = st.track_id AND i.n = st.n + 1),
regions AS (SELECT track_id, region_no, any_value(rs) AS start_ms, max(re) AS end_ms, any_value(rt) AS censor_type, count(*) FILTER (WHERE counted) AS n_words FROM st GROUP BY track_id, region_no)"""
MIXED = FOLD.replace("{iv}", intervals_sql("coalesce(censor_type, 'mute')"))
PLAN = FOLD.replace("{iv}", intervals_sql("coalesce(censor_type, default_censor_type)"))


@query("h3_censor_regions_mixed", MIXED + " SELECT * FROM regions")
def h3_mixed(spark, sf):
    """Mixed types: overlapping words of another type are trimmed or dropped."""
    return timeline.censor_regions(_with_duration(fx.dense_flags(spark, sf), spark, sf))


@query("g13_coverage_report", MIXED + """, c AS (SELECT track_id, count(*) AS n_regions, sum(end_ms - start_ms)::BIGINT AS total_ms FROM regions GROUP BY track_id)
SELECT track_id, n_regions, total_ms, duration_ms, round(100.0 * total_ms / duration_ms, 6) AS pct, 100.0 * total_ms / duration_ms > 20 AS too_much FROM c JOIN tracks USING (track_id)""")
def g13(spark, sf):
    regions = timeline.censor_regions(_with_duration(fx.dense_flags(spark, sf), spark, sf))
    return reports.coverage_report(regions, fx.tracks(spark, sf))


@query(
    "h8_flag_navigation",
    f"""WITH {fx.DENSE}, f AS (SELECT track_id, pos FROM dense WHERE is_profanity)
SELECT track_id, pos, coalesce(lag(pos) OVER o, last_value(pos) OVER w) AS prev_pos, coalesce(lead(pos) OVER o, first_value(pos) OVER w) AS next_pos FROM f
WINDOW o AS (PARTITION BY track_id ORDER BY pos), w AS (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def h8(spark, sf):
    return timeline.flag_navigation(fx.dense_flags(spark, sf))


# Clean words only: the later word yields, is trimmed or dropped. Clusters keep the recursion short.
NORMAL_SQL = f"""WITH RECURSIVE {fx.OVERLAP}, m AS (SELECT track_id, pos, start_ms, end_ms, max(end_ms) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM overlap),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR start_ms >= b THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY pos) AS cl FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, cl ORDER BY pos) AS n FROM g),
st AS (SELECT track_id, cl, n, pos, start_ms AS s, end_ms AS e, end_ms AS top, true AS kept FROM r WHERE n = 1
UNION ALL SELECT r.track_id, r.cl, r.n, r.pos, greatest(r.start_ms, st.top), r.end_ms, CASE WHEN r.start_ms >= st.top OR r.end_ms - st.top >= 50 THEN r.end_ms ELSE st.top END,
  r.start_ms >= st.top OR r.end_ms - st.top >= 50 FROM st JOIN r ON r.track_id = st.track_id AND r.cl = st.cl AND r.n = st.n + 1)
SELECT track_id, pos, s AS start_ms, e AS end_ms FROM st WHERE kept"""


@query("h1_normalize_timeline_clean", NORMAL_SQL)
def h1_clean(spark, sf):
    w = fx.overlapping_words(spark, sf).withColumn("is_profanity", F.lit(False))
    return timeline.normalize_timeline(w).select("track_id", "pos", "start_ms", "end_ms")


@query("h1_normalize_timeline")
def h1(spark, sf):
    """Flagged, clean and estimated words mixed, inside the track's bounds."""
    out = timeline.normalize_timeline(fx.dense_flags(spark, sf), fx.tracks(spark, sf))
    return out.select("track_id", "pos", "word", "start_ms", "end_ms", "is_profanity", "detection_source")


@query(
    "h1_normalized_violations",
    f"WITH {fx.MIX}, t AS (SELECT track_id, count(*) AS n FROM mix GROUP BY ALL) SELECT track_id, 0::BIGINT AS n_violations FROM t",
)
def h1_check(spark, sf):
    """Violations per track after normalising: none anywhere."""
    out = timeline.normalize_timeline(fx.dense_flags(spark, sf), fx.tracks(spark, sf))
    out = timeline.reindex(out)
    bad = timeline.check_timeline(out).groupBy("track_id").agg(F.count("*").alias("n"))
    return out.select("track_id").distinct().join(bad, "track_id", "left").select(
        "track_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_violations")
    )


def _crammed(spark, sf):
    w = fx.mix_words(spark, sf)
    return w.withColumn("start_ms", F.col("pos") * 50).withColumn("end_ms", F.col("pos") * 50 + 40)


@query("h4_collapse_repeats")
def h4(spark, sf):
    """All tokens squeezed to 20 words a second: every long repeat counts as crammed."""
    return timeline.collapse_repeats(_crammed(spark, sf)).select("track_id", "pos", "word")


# One-word repeats on their own: runs of equal words, cycles kept where 180 ms have passed.
H4_SQL = f"""WITH {fx.MIX}, s AS (SELECT track_id, pos, {fx.sq('word')} AS w FROM mix),
x AS (SELECT *, CASE WHEN w <> '' AND w = lag(w) OVER (PARTITION BY track_id ORDER BY pos) THEN 0 ELSE 1 END AS o FROM s),
r AS (SELECT *, sum(o) OVER (PARTITION BY track_id ORDER BY pos) AS run FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY pos) - 1 AS c, count(*) OVER (PARTITION BY track_id, run) AS n FROM r)
SELECT track_id, max(n) AS longest_run, count(*) AS n_words FROM k GROUP BY track_id"""


@query("h4_repeat_runs", H4_SQL)
def h4_runs(spark, sf):
    """The longest run of one repeated word per track, by the same neighbour and numbering steps."""
    from lexiline.functions import text
    from lexiline.operators import blocks

    norm = text.squash("word")
    near = blocks.neighbours(fx.mix_words(spark, sf), ["track_id"], {"p": (norm, -1)})
    opens = F.when((norm != "") & (norm == F.col("p")), 0).otherwise(1).cast("long")
    runs = blocks.scan(near, ["track_id"], ["pos"], {"run": ("sum", opens)}, width=4096)
    sizes = runs.groupBy("track_id", "run").agg(F.count("*").alias("n"))
    return sizes.groupBy("track_id").agg(F.max("n").alias("longest_run"), F.sum("n").alias("n_words"))


@query(
    "j1_reindexed_union",
    f"""WITH {fx.FLAGGED}{fx.STEM}, u AS (SELECT track_id, word, start_ms, end_ms, '' AS src, pos AS id FROM flagged UNION ALL SELECT track_id, word, start_ms, end_ms, 'adlib', pos FROM stem)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, id, src, word) - 1 AS pos, word, start_ms FROM u""",
)
def j1(spark, sf):
    """First pass plus second pass as one timeline, renumbered."""
    second = fx.stem_words(spark, sf).withColumn("detection_source", F.lit("adlib"))
    out = timeline.reindex(timeline.add_words(fx.flagged_words(spark, sf), second))
    return out.select("track_id", "pos", "word", "start_ms")


@query(
    "p3_plan_censoring",
    PLAN + """, c AS (SELECT track_id, sum(end_ms - start_ms)::BIGINT AS total_ms FROM regions GROUP BY track_id)
SELECT r.track_id, region_no, start_ms, end_ms, censor_type, n_words, total_ms, round(100.0 * total_ms / duration_ms, 6) AS pct FROM regions r JOIN c USING (track_id) JOIN tracks USING (track_id)""",
)
def p3(spark, sf):
    from lexiline.plans import jobs

    regions, report = jobs.plan_censoring(fx.dense_flags(spark, sf), fx.tracks(spark, sf))
    return regions.join(report.select("track_id", "total_ms", "pct"), "track_id")


@query(
    "p4_diagnose",
    f"""WITH {fx.DENSE}, {fx.TRACKS}, {intervals_sql("'mute'")},
m AS (SELECT *, max(hi) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR lo > b THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY n) - 1 AS region_no FROM m),
d AS (SELECT track_id, pos, coalesce(detection_source, 'primary') AS src FROM dense)
SELECT track_id, region_no::BIGINT AS region_no, pos AS word_id, word || '(' || src || ')' AS word FROM g JOIN d USING (track_id, pos)""",
)
def p4(spark, sf):
    """The region every flagged word ends up in, labelled by its detector."""
    return reports.diagnose(fx.dense_flags(spark, sf), fx.tracks(spark, sf))["region_words"]
