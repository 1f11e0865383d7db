"""Metadata resolution, caches and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiline.operators import catalog as cat
from lexiline.registry import fixtures as fx
from lexiline.registry.base import query
from lexiline.registry.text import junk_sql, segments_sql


def dirty_tracks(spark, sf):
    """Parts as badly tagged tracks: rip-site artist, everything in the title, swapped or missing tags."""
    k = F.col("p_partkey")
    p = fx.table(spark, sf, "part")
    return p.select(
        k.alias("track_id"),
        F.when(k % 4 == 0, "Radio Channel ®").when(k % 4 == 1, F.col("p_brand")).when(k % 4 == 2, F.col("p_name")).alias("artist"),
        F.when(k % 4 == 0, F.concat("p_brand", F.lit(" - "), "p_name")).when(k % 4 == 1, F.concat("p_name", F.lit(" (Radio Edit)")))
        .when(k % 4 == 2, F.col("p_brand")).alias("title"),
        F.concat(F.lit("/m/"), "p_brand", F.lit(" - "), "p_name", F.lit(" - 05 - SiteName.com.mp3")).alias("file_name"),
        F.when(k % 5 != 0, (150 + F.col("p_size")) * 1000 + F.when(k % 3 == 0, 0).when(k % 3 == 1, 4000).otherwise(6000)).cast("long").alias("duration_ms"),
    )


def catalog(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 10 != 0, (150 + F.col("p_size")) * 1000).cast("long").alias("duration_ms"),
        F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" text"))).alias("plain"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("[0:01.00] "), "p_name")).alias("synced"),
        (F.col("p_partkey") % 7).alias("rank"),
    )


CANDS = f"""dt AS (SELECT p_partkey AS track_id, CASE p_partkey % 4 WHEN 0 THEN 'Radio Channel ®' WHEN 1 THEN p_brand WHEN 2 THEN p_name END AS artist,
  CASE p_partkey % 4 WHEN 0 THEN p_brand || ' - ' || p_name WHEN 1 THEN p_name || ' (Radio Edit)' WHEN 2 THEN p_brand END AS title,
  p_brand || ' - ' || p_name || ' - 05 - SiteName.com' AS base,
  CASE WHEN p_partkey % 5 <> 0 THEN (150 + p_size) * 1000 + CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 4000 ELSE 6000 END END::BIGINT AS duration_ms FROM part),
sg AS (SELECT *, {segments_sql('title')} AS ts, {segments_sql('base')} AS fs, regexp_matches(title, '\\s+[-–—]\\s+') AS dash FROM dt),
c0 AS (SELECT track_id, duration_ms, 0 AS ord, {junk_sql('artist')} AS artist, {junk_sql('title')} AS title FROM sg WHERE artist IS NOT NULL
UNION ALL SELECT track_id, duration_ms, 1, {junk_sql('ts[1]')}, {junk_sql('ts[2]')} FROM sg WHERE dash AND len(ts) >= 2
UNION ALL SELECT track_id, duration_ms, 2, {junk_sql('fs[1]')}, {junk_sql('fs[2]')} FROM sg WHERE len(fs) >= 2
UNION ALL SELECT track_id, duration_ms, 3, {junk_sql('title')}, {junk_sql('artist')} FROM sg WHERE artist IS NOT NULL AND NOT regexp_matches(artist || title, '\\s+[-–—]\\s+')),
c1 AS (SELECT * FROM c0 WHERE artist <> '' AND title <> '' QUALIFY row_number() OVER (PARTITION BY track_id, lower(artist), lower(title) ORDER BY ord) = 1),
cands AS (SELECT track_id, duration_ms, row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1 AS candidate_no, artist, title FROM c1)"""


@query("e10_metadata_candidates", f"WITH {CANDS} SELECT * FROM cands")
def e10(spark, sf):
    return cat.metadata_candidates(dirty_tracks(spark, sf))


# Titles here lose at most the one version tag the fixture adds.
MATCH = f"""WITH {CANDS}, cl AS (SELECT p_partkey AS entry_id, p_brand AS c_artist, p_name AS c_title, CASE WHEN p_size % 10 <> 0 THEN (150 + p_size) * 1000 END AS cd,
  CASE WHEN p_size % 3 = 0 THEN p_name || ' text' END AS plain, CASE WHEN p_size % 3 <> 0 THEN '[0:01.00] ' || p_name END AS synced, p_partkey % 7 AS rank FROM part),
j AS (SELECT c.*, cl.*, lower(c_artist) = lower(c.artist) AS ex, contains(lower(c_artist), lower(c.artist)) AS fu, c.duration_ms IS NULL OR coalesce(abs(cd - c.duration_ms) <= 5000, false) AS close,
  c.duration_ms IS NULL OR coalesce(abs(cd - c.duration_ms) <= 2000, false) AS near FROM cands c JOIN cl ON lower(c_title) = lower(replace(c.title, ' (Radio Edit)', ''))),
r AS (SELECT *, 0 AS rung, true AS ok FROM j WHERE ex AND near UNION ALL SELECT *, 1, close FROM j WHERE fu UNION ALL SELECT *, 3, true FROM j WHERE candidate_no = 0 AND close),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY track_id, candidate_no ORDER BY NOT ok, rung, rank, entry_id) = 1),
matched AS (SELECT track_id, candidate_no, entry_id, rung::BIGINT AS rung, CASE WHEN ok OR plain IS NOT NULL THEN plain ELSE replace(synced, '[0:01.00] ', '') END AS plain, CASE WHEN ok THEN synced END AS synced, NOT ok AS duration_mismatch FROM b)"""


@query("e11_match_catalog", MATCH + " SELECT * FROM matched")
def e11(spark, sf):
    return cat.match_catalog(cat.metadata_candidates(dirty_tracks(spark, sf)), catalog(spark, sf))


def _source_a(spark, sf):
    return cat.metadata_candidates(dirty_tracks(spark, sf)).select(
        "track_id", "candidate_no", F.when(F.col("track_id") % 3 == 0, F.concat(F.lit("A "), "title")).otherwise("").alias("plain")
    )


MERGED = MATCH + """, a AS (SELECT track_id, candidate_no, CASE WHEN track_id % 3 = 0 THEN 'A ' || title END AS ap FROM cands),
m AS (SELECT track_id, candidate_no, coalesce(ap, plain) AS plain, synced, CASE WHEN ap IS NOT NULL THEN 'a' WHEN plain IS NOT NULL OR synced IS NOT NULL THEN 'b' END AS source,
  coalesce(duration_mismatch, false) AS duration_mismatch FROM a FULL JOIN matched USING (track_id, candidate_no) WHERE coalesce(ap, plain, synced) IS NOT NULL)"""


@query("e12_merge_sources", MERGED + " SELECT * FROM m")
def e12(spark, sf):
    cands = cat.metadata_candidates(dirty_tracks(spark, sf))
    return cat.merge_sources(_source_a(spark, sf), cat.match_catalog(cands, catalog(spark, sf)))


@query(
    "e13_resolve_reference",
    MATCH + """ SELECT track_id, candidate_no, plain, synced, 'b' AS source, duration_mismatch, candidate_no = 0 AS from_tags FROM matched
QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY candidate_no) = 1""",
)
def e13(spark, sf):
    return cat.resolve_reference(dirty_tracks(spark, sf), catalog(spark, sf))


CACHE_SQL = """WITH f AS (SELECT user_id, arg_max(value, ts) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AND user_id % 3 <> 0 GROUP BY user_id)
SELECT c_custkey AS key, value FROM customer LEFT JOIN f ON user_id = c_custkey"""


@query("e14_cached_lookup", CACHE_SQL)
def e14(spark, sf):
    """Customers as requests, events as cache entries: hits with their value, misses without."""
    req = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    cache = fx.table(spark, sf, "events").filter("user_id % 3 <> 0").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("cached_at"), "value"
    )
    hits, misses = cat.cached_lookup(req, cache, "2024-01-31 00:00:00", "10 DAYS")
    return hits.unionByName(misses.withColumn("value", F.lit(None).cast("double")))


KEYS = ("TPE1", "GEOB:Serato Markers2", "TLEN", "TXXX:note", "TRAKTOR4")


def _tags(spark, sf):
    keys = F.array(*[F.lit(k) for k in KEYS])
    p = fx.table(spark, sf, "part").select("p_partkey", F.posexplode(keys).alias("n", "key"))
    row = lambda key: (F.col("p_partkey").alias("track_id"), F.lit("id3").alias("container"), key.alias("key"), F.encode("key", "UTF-8").alias("value"))
    src = p.filter((F.col("p_partkey") + F.col("n")) % 3 != 0).select(*row(F.col("key")))
    dst = p.filter((F.col("p_partkey") + F.col("n")) % 4 == 0).select(*row(F.lower("key")))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("mp3", "wav", "flac", "ogg")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    pairs = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("track_id"), F.lit("mp3").alias("src_ext"), ext.alias("dst_ext"))
    return src, dst, pairs


TAGS = f"""k AS (SELECT p_partkey AS track_id, unnest({list(KEYS)!r}) AS key, unnest(range(5)) AS n FROM part), src AS (SELECT * FROM k WHERE (track_id + n) % 3 <> 0),
dst AS (SELECT track_id, lower(key) AS key FROM k WHERE (track_id + n) % 4 = 0),
cp AS (SELECT track_id, key FROM src s WHERE track_id % 4 < 2 AND key <> 'TLEN' AND NOT EXISTS (SELECT 1 FROM dst d WHERE d.track_id = s.track_id AND d.key = lower(s.key))),
al AS (SELECT track_id, key, false AS copied FROM dst UNION ALL SELECT track_id, key, true FROM cp)"""


@query("e16_merge_tags", f"WITH {TAGS} SELECT * FROM al")
def e16(spark, sf):
    return cat.merge_tags(*_tags(spark, sf))[0].select("track_id", "key", "copied")


@query(
    "e16_merge_tags_report",
    f"""WITH {TAGS}, n AS (SELECT track_id, count(*) AS n FROM cp GROUP BY ALL), lost AS (SELECT DISTINCT track_id FROM src s WHERE regexp_matches(lower(key), 'serato|traktor') AND NOT EXISTS (SELECT 1 FROM al WHERE al.track_id = s.track_id AND lower(al.key) = lower(s.key)))
SELECT p_partkey AS track_id, CASE p_partkey % 4 WHEN 2 THEN 'format_change' WHEN 3 THEN 'unsupported_container' END AS reason, coalesce(n, 0) AS n_copied, p_partkey % 4 < 2 AND p_partkey NOT IN (SELECT track_id FROM lost) AS preserved
FROM part LEFT JOIN n ON n.track_id = p_partkey""",
)
def e16_report(spark, sf):
    return cat.merge_tags(*_tags(spark, sf))[1]


@query("j2_missing_tags", f"WITH {TAGS} SELECT DISTINCT track_id, lower(key) AS key FROM src s WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.track_id = s.track_id AND lower(al.key) = lower(s.key))")
def j2(spark, sf):
    """Source tags that are on no target after the merge."""
    src, dst, pairs = _tags(spark, sf)
    return cat.missing_tags(src, cat.merge_tags(src, dst, pairs)[0])
