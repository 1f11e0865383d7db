"""Dirty metadata against a catalog: candidate readings, the fallback ladder, merging, caching, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiline import fixed
from lexiline.functions import text

TOLERANCE_MS = 5000
EXACT_MS = 2000


def metadata_candidates(tracks: DataFrame) -> DataFrame:
    """Up to four (artist, title) readings per track, best first: tags as they are, a split title, a
    split file name, swapped tags. A track's readings are one short array: no shuffle."""
    clean = lambda c: text.strip_junk(F.coalesce(c, F.lit("")))
    pair = lambda a, t: F.struct(clean(a).alias("artist"), clean(t).alias("title"))
    none = F.lit(None).cast("struct<artist: string, title: string>")

    def split(c):
        segs = text.split_segments(F.coalesce(c, F.lit("")))
        return F.when(F.size(segs) >= 2, pair(F.get(segs, 0), F.get(segs, 1))).otherwise(none)

    base = F.regexp_replace(F.regexp_replace("file_name", r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    both = (F.coalesce("artist", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    readings = F.array(
        pair(F.col("artist"), F.col("title")),
        F.when(text.has_spaced_dash(F.coalesce("title", F.lit(""))), split(F.col("title"))).otherwise(none),
        split(base),
        F.when(both & ~text.has_spaced_dash(F.concat("artist", "title")), pair(F.col("title"), F.col("artist"))).otherwise(none),
    )
    valid = F.filter(readings, lambda r: r.isNotNull() & (r["artist"] != "") & (r["title"] != ""))
    same = lambda a, b: (F.lower(a["artist"]) == F.lower(b["artist"])) & (F.lower(a["title"]) == F.lower(b["title"]))
    distinct = F.aggregate(
        valid, F.slice(valid, 1, 0),
        lambda acc, r: F.when(F.exists(acc, lambda k: same(k, r)), acc).otherwise(F.concat(acc, F.array(r))),
    )
    rows = tracks.select("track_id", "duration_ms", F.posexplode(F.slice(distinct, 1, 4)).alias("candidate_no", "r"))
    return rows.select("track_id", "duration_ms", F.col("candidate_no").cast("long").alias("candidate_no"), "r.artist", "r.title")


def _artist_hits(cands: DataFrame, entries: DataFrame) -> DataFrame:
    """(__k, artist, __have, __exact, __full): entry artists of the title that contain the artist or the primary artist.

    A text that contains another one contains its first three letters, so distinct spellings meet on the title and
    those letters instead of on the title alone.
    """
    want, primary = F.lower("artist"), F.lower(text.primary_artist("artist"))
    wanted = cands.select("__k", "artist", want.alias("__want"), primary.alias("__primary")).distinct()
    begins = F.array_distinct(F.transform(F.array("__want", "__primary"), lambda w: F.substring(w, 1, 3)))
    wanted = wanted.withColumn("__gram", F.explode(begins))
    places = F.sequence(F.lit(1), F.length("__have"))
    grams = F.flatten(F.transform(places, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.col("__have").substr(i, n))))
    held = entries.select("__k", "__have").distinct().withColumn("__gram", F.explode(F.array_union(F.array(F.lit("")), F.when(F.length("__have") > 0, grams).otherwise(F.array()))))
    full = F.col("__have").contains(F.col("__want"))
    first = (F.col("__primary") != "") & (F.col("__primary") != F.col("__want")) & F.col("__have").contains(F.col("__primary"))
    near = wanted.join(held, ["__k", "__gram"]).filter(full | first)
    return near.select("__k", "artist", "__have", (F.col("__have") == F.col("__want")).alias("__exact"), full.alias("__full")).distinct()


def match_catalog(cands: DataFrame, catalog: DataFrame) -> DataFrame:
    """One catalog entry per candidate, by the ladder: exact artist and title; title with the full
    artist; title with the primary artist; title alone (first candidate only).

    Exact hits need a duration within two seconds. A search rung is won by its first entry within five;
    an entry without duration is not trusted when the track has one. If no rung is won, the first
    artist-matched entry keeps its text and loses its timing. Unknown track durations accept the
    first entry. Entries are folded to the best of each (title, artist, duration), (title, artist), (title, duration)
    and title, and rungs are equi joins with these: durations meet in buckets, artists by `_artist_hits`.
    """
    usable = (F.coalesce("plain", F.lit("")) != "") | (F.coalesce("synced", F.lit("")) != "")
    entries = catalog.filter(usable).select(
        F.lower(F.trim("title")).alias("__k"), F.lower(F.coalesce("artist", F.lit(""))).alias("__have"),
        F.col("duration_ms").alias("__off"), F.struct(F.col("rank").alias("c_rank"), "entry_id", "plain", "synced").alias("__e"),
    )
    first_of = lambda df, *by: df.groupBy(*by).agg(F.min_by("__e", F.struct("__e.c_rank", "__e.entry_id")).alias("__e"))
    # Copies of an entry differ by rank only: they are folded before any join.
    entries = first_of(entries, "__k", "__have", "__off")
    bucket = lambda c: F.floor(c / (TOLERANCE_MS + 1))
    timed = entries.filter("__off is not null").withColumn("__b", bucket(F.col("__off")))
    c = cands.withColumn("__k", F.lower(F.trim(text.clean_title("title"))))
    c = c.select("track_id", "candidate_no", "duration_ms", "artist", "__k")
    hits = c.join(_artist_hits(c, entries), ["__k", "artist"])
    around = lambda df: df.filter("duration_ms is not null").withColumn("__b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: bucket(F.col("duration_ms")) + d)))
    off = F.abs(F.col("__off") - F.col("duration_ms"))
    unknown = F.col("duration_ms").isNull()
    searched = F.when(F.col("__full"), 1).otherwise(2)
    row = lambda df, rung, ok: df.select("track_id", "candidate_no", rung.alias("rung"), ok.alias("ok"), "__e")
    yes = F.lit(True)
    by_time = around(hits).join(timed, ["__k", "__have", "__b"]).filter(off <= TOLERANCE_MS)
    anyway = hits.join(first_of(entries, "__k", "__have"), ["__k", "__have"])
    leading = c.filter("candidate_no = 0")
    title_time = around(leading).join(first_of(timed, "__k", "__off", "__b"), ["__k", "__b"]).filter(off <= TOLERANCE_MS)
    title_only = leading.filter(unknown).join(first_of(entries, "__k"), "__k")
    j = (
        row(by_time, F.when(F.col("__exact") & (off <= EXACT_MS), 0).otherwise(searched), yes)
        .unionByName(row(anyway, F.when(unknown & F.col("__exact"), 0).otherwise(searched), unknown))
        .unionByName(row(title_time, F.lit(3), yes))
        .unionByName(row(title_only, F.lit(3), yes))
    )
    order = F.struct((~F.col("ok")).alias("miss"), "rung", "__e.c_rank", "__e.entry_id")
    row_of = F.struct("__e.entry_id", "rung", "__e.plain", "__e.synced", "ok")
    best = j.groupBy("track_id", "candidate_no").agg(F.min_by(row_of, order).alias("b"))
    stripped = F.regexp_replace(F.col("b.synced"), r"(?m)^[ \t]*\[[0-9]+:[0-9]+\.[0-9]+\][ \t]*", "")
    has_plain = F.coalesce(F.col("b.plain"), F.lit("")) != ""
    return best.select(
        "track_id", "candidate_no", "b.entry_id", F.col("b.rung").cast("long").alias("rung"),
        F.when(F.col("b.ok") | has_plain, F.col("b.plain")).otherwise(stripped).alias("plain"),
        F.when(F.col("b.ok"), F.col("b.synced")).alias("synced"),
        (~F.col("b.ok")).alias("duration_mismatch"),
    )


def merge_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Source A's plain text first, source B's timed text always; `source` tells whose plain text it is."""
    key = ["track_id", "candidate_no"]
    left = a.select(*key, F.when(F.col("plain") != "", F.col("plain")).alias("a_plain"))
    right = b.select(*key, F.when(F.col("plain") != "", F.col("plain")).alias("b_plain"), F.when(F.col("synced") != "", F.col("synced")).alias("synced"), "duration_mismatch")
    j = left.join(right, key, "full")
    out = j.select(
        *key,
        F.coalesce("a_plain", "b_plain").alias("plain"),
        "synced",
        F.when(F.col("a_plain").isNotNull(), "a").when(F.col("b_plain").isNotNull() | F.col("synced").isNotNull(), "b").alias("source"),
        F.coalesce("duration_mismatch", F.lit(False)).alias("duration_mismatch"),
    )
    return out.filter(F.col("plain").isNotNull() | F.col("synced").isNotNull())


def resolve_reference(tracks: DataFrame, catalog: DataFrame, source_a: DataFrame | None = None) -> DataFrame:
    """The first candidate that yields any text; `from_tags` is true only for the tags as they are.

    `source_a` (artist, title, plain) is matched on case-blind artist and cleaned title.
    """
    cands = metadata_candidates(tracks)
    b = match_catalog(cands, catalog)
    if source_a is None:
        a = b.select("track_id", "candidate_no", F.lit(None).cast("string").alias("plain")).limit(0)
    else:
        s = source_a.select(F.lower("title").alias("__t"), F.col("artist").alias("__a"), F.col("plain"))
        j = cands.withColumn("__t", F.lower(text.clean_title("title"))).join(s, "__t")
        j = j.filter(text.artist_matches("artist", "__a") & text.looks_like_lyrics("plain"))
        a = j.groupBy("track_id", "candidate_no").agg(F.min_by("plain", F.struct("__a", "plain")).alias("plain"))
    merged = merge_sources(a, b)
    best = merged.groupBy("track_id").agg(
        F.min_by(F.struct("candidate_no", "plain", "synced", "source", "duration_mismatch"), "candidate_no").alias("b")
    )
    return best.select("track_id", "b.*", (F.col("b.candidate_no") == 0).alias("from_tags"))


def cached_lookup(requests: DataFrame, cache: DataFrame, now: str, ttl: str = "30 DAYS") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests against cache rows (key, cached_at, value) younger than the limit."""
    fresh = cache.filter(F.col("cached_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl}"))
    newest = fresh.groupBy("key").agg(F.max_by("value", "cached_at").alias("value"))
    return requests.join(newest, "key"), requests.join(newest.select("key"), "key", "left_anti")


def merge_tags(src: DataFrame, dst: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy source tags the target lacks (by lower-case key), never overwriting; and a verdict per track.

    `pairs` has (track_id, src_ext, dst_ext). Nothing is copied across container families, and stale
    length tags stay behind.
    """
    p = pairs.withColumn("__s", text.container_family("src_ext")).withColumn("__d", text.container_family("dst_ext"))
    reason = (
        F.when(F.col("src_ext").isNull(), "no_source")
        .when(F.col("__s").isNull() | F.col("__d").isNull(), "unsupported_container")
        .when(F.col("__s") != F.col("__d"), "format_change")
    )
    p = p.withColumn("reason", reason)
    stale = F.lower(F.split("key", ":")[0]).isin(*fixed.STALE_TAG_KEYS)
    able = p.filter("reason IS NULL").select("track_id", F.col("__d").alias("container"))
    offered = src.filter(~stale).drop("container").join(able, "track_id").withColumn("__k", F.lower("key"))
    have = dst.select("track_id", F.lower("key").alias("__k"))
    copied = offered.join(have, ["track_id", "__k"], "left_anti").drop("__k")
    merged = dst.withColumn("copied", F.lit(False)).unionByName(copied.withColumn("copied", F.lit(True)))
    marker = F.lit(False)
    for m in fixed.DJ_TAG_MARKERS:
        marker = marker | F.lower("key").contains(m)
    # A merge preserved everything when no marked source key is missing afterwards.
    lost = src.filter(marker).select("track_id", F.lower("key").alias("__k")).join(
        merged.select("track_id", F.lower("key").alias("__k")), ["track_id", "__k"], "left_anti"
    ).select("track_id").distinct().withColumn("__lost", F.lit(True))
    counts = copied.groupBy("track_id").agg(F.count("*").alias("n_copied"))
    report = p.join(counts, "track_id", "left").join(lost, "track_id", "left").select(
        "track_id", "reason", F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        (F.col("reason").isNull() & F.col("__lost").isNull()).alias("preserved"),
    )
    return merged, report


def missing_tags(src: DataFrame, out: DataFrame) -> DataFrame:
    """Source tags that did not survive; empty when the containment holds."""
    key = lambda d: d.select("track_id", F.lower("key").alias("key"))
    return key(src).join(key(out), ["track_id", "key"], "left_anti")
