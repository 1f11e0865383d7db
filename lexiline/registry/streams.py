"""S: streaming operators, drained over the given tables and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiline import fixed
from lexiline.registry import fixtures as fx
from lexiline.registry.base import query
from lexiline.registry.text import _forms_sql
from lexiline.registry.usage import users
from lexiline.sources import tables
from lexiline.streaming import streams

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def _events(spark, sf):
    return tables.read_event_stream(spark, f"{sf}/events*.parquet")


def _words(spark, sf):
    docs = spark.readStream.schema(DOCS).parquet(f"{sf}/documents*.parquet")
    return tables.words_from_text(docs, "doc_id", "text", keep=("lang",))


@query("s1_stream_flag_terms", f"WITH {fx.MIX} SELECT track_id, pos, word FROM mix WHERE list_has_any({_forms_sql('lower(word)', True)}, {list(fx.TERMS)!r})")
def s1(spark, sf):
    out = streams.stream_flag_terms(_words(spark, sf), fx.lexicon(spark), allowlist=(), tiers=("exact",))
    return out.filter("match_type IS NOT NULL").select("track_id", "pos", "word")


S2_GAPS = fixed.GAP_WORDS
S2_SQL = f"""WITH {fx.MIX}, n AS (SELECT track_id, pos, {fx.sq('word')} AS w, lag(pos) OVER t AS p1, lag({fx.sq('word')}) OVER t AS w1, lag(pos, 2) OVER t AS p2, lag({fx.sq('word')}, 2) OVER t AS w2 FROM mix WINDOW t AS (PARTITION BY track_id ORDER BY pos)),
h AS (SELECT track_id, unnest([p1, pos]) AS pos, 'adjacent' AS kind FROM n WHERE w1 || '+' || w IN {fx.in_list('+'.join(p) for p in fx.PAIRS)}
UNION ALL SELECT track_id, unnest([p1, pos]), 'joined' FROM n WHERE length(w1) >= {fixed.JOINED_MIN_LEN} AND length(w) >= {fixed.JOINED_MIN_LEN} AND w1 || w IN {fx.in_list(fx.TERMS)}
UNION ALL SELECT track_id, unnest([p2, p1, pos]), 'gapped' FROM n WHERE w1 IN {fx.in_list(S2_GAPS)} AND w2 || '+' || w IN {fx.in_list('+'.join(p) for p in fx.PAIRS)})
SELECT DISTINCT track_id, pos, kind FROM h"""


@query("s2_stream_compounds", S2_SQL)
def s2(spark, sf):
    found = streams.stream_compounds(_words(spark, sf), fx.PAIRS, S2_GAPS, fx.lexicon(spark), allowlist=())
    return streams.run_to_table(found).distinct()


@query(
    "s3_stream_counters",
    "SELECT epoch_us(date_trunc('day', ts))::BIGINT AS window_us, user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def s3(spark, sf):
    out = streams.run_to_table(streams.stream_counters(_events(spark, sf)), "update", keys=["window_start", "user_id", "event_type"])
    return out.select(F.unix_micros("window_start").alias("window_us"), "user_id", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "s3_stream_sliding",
    """WITH w AS (SELECT user_id, event_type, value, unnest(generate_series(epoch(ts)::BIGINT // 21600 * 21600 - 64800, epoch(ts)::BIGINT // 21600 * 21600, 21600)) AS s FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events))
SELECT (s * 1000000)::BIGINT AS window_us, user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""",
)
def s3_sliding(spark, sf):
    """Windows of a day that start every six hours."""
    out = streams.stream_sliding_counters(_events(spark, sf))
    return out.select(F.unix_micros("window_start").alias("window_us"), "user_id", "event_type", "n", F.round("total", 4).alias("total"))


LATE_PART = "CASE WHEN event_id % 40 = 0 THEN 2 WHEN event_id % 40 = 20 OR ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END"


@query(
    "s3_late_rows",
    f"""WITH p AS (SELECT event_id, epoch_us(ts) AS us, {LATE_PART} AS part FROM events), m AS (SELECT part, max(us) AS mark FROM p GROUP BY ALL)
SELECT event_id, coalesce(us < (SELECT max(mark) FROM m WHERE m.part < p.part) - 3600000000, false) AS is_late FROM p""",
)
def s3_late(spark, sf):
    """All events, replayed in three parts that are drained one after the other; some come parts after their time."""
    parts, path = streams._folder(spark, "parts"), streams._folder(spark, "late")
    raw = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("part", F.expr(LATE_PART.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    for k in range(3):
        raw.filter(F.col("part") == k).drop("part").write.mode("append").parquet(parts)
        rows = streams.split_late(tables.read_event_stream(spark, parts, max_files=1_000_000), path=path)
    return rows.select("event_id", "is_late")


@query(
    "s4_stream_quota_gate",
    """SELECT user_id, event_id, user_id % 5 = 0 OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2 AS admitted FROM events WHERE event_type = 'purchase'""",
)
def s4(spark, sf):
    subscribed = users(spark, sf).filter("status = 'active'").select(F.col("uid").alias("user_id"))
    gate = streams.stream_quota_gate(_events(spark, sf).filter("event_type = 'purchase'"), subscribed)
    return streams.run_to_table(gate)


S5_SQL = f"""WITH l AS (SELECT event_id % 400 AS sub_id, arg_max(event_type, event_id) AS et FROM events GROUP BY ALL),
s AS (SELECT sub_id, sub_id % 150 AS customer_id, CASE et WHEN 'view' THEN 'active' WHEN 'click' THEN 'past_due' WHEN 'error' THEN 'unpaid' ELSE 'canceled' END AS status FROM l),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY list_position({list(fixed.STATUS_PRIORITY)!r}, status), sub_id) = 1),
n AS (SELECT customer_id, count(*) FILTER (WHERE status <> 'canceled') AS billable_count FROM s GROUP BY ALL)
SELECT customer_id, CASE WHEN status = 'unpaid' THEN 'canceled' ELSE status END AS status, billable_count FROM b JOIN n USING (customer_id)"""


@query("s5_stream_reconcile", S5_SQL)
def s5(spark, sf):
    """Events as billing events of 400 subscriptions: only the latest state of each counts."""
    status = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "past_due").when(F.col("event_type") == "error", "unpaid").otherwise("canceled")
    subs = _events(spark, sf).select(
        (F.col("event_id") % 400).alias("sub_id"), (F.col("event_id") % 400 % 150).alias("customer_id"), status.alias("status"),
        F.col("ts").alias("period_end"), F.lit(False).alias("cancel_at_period_end"), F.col("event_id").alias("seq"),
    )
    return streams.stream_reconcile(subs).select("customer_id", "status", "billable_count")


@query(
    "s6_sessionize",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o) SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*) AS n FROM g GROUP BY user_id, g""",
)
def s6(spark, sf):
    out = streams.run_to_table(streams.sessionize(_events(spark, sf)), "complete")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


@query("s7_detect_stalled")
def s7(spark, sf):
    return streams.run_to_table(streams.detect_stalled(_events(spark, sf)))


@query("s8_dedupe_events", "SELECT event_id, user_id FROM events")
def s8(spark, sf):
    """The events replayed next to themselves: each once."""
    twice = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.run_to_table(streams.dedupe_events(twice)).select("event_id", "user_id")
