"""B: normalising projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiline import fixed
from lexiline.functions import similarity, text
from lexiline.operators import detect
from lexiline.registry import fixtures as fx
from lexiline.registry.base import query

VOCAB = fx.MIX + ", vocab AS (SELECT DISTINCT word FROM mix)"


def _vocab(spark, sf):
    return detect.dictionary(fx.mix_words(spark, sf))


def _forms_sql(x: str, lower_only: bool = False) -> str:
    w = fx.WCLASS
    base = [x, f"regexp_replace({x}, '[^{w}'']$', '')", f"regexp_replace({x}, '[^{w}]', '', 'g')", f"regexp_replace({x}, '''+$', '')"]
    cased = base if lower_only else [v for b in base for v in (b, f"lower({b})")]
    every = cased + [f"strip_accents({v})" for v in cased]
    return f"list_sort(list_distinct(list_filter([{', '.join(every)}], lambda v: v <> '')))"


@query("b1_normal_forms", f"WITH {VOCAB} SELECT word, array_to_string({_forms_sql('word')}, ' ') AS forms FROM vocab")
def b1(spark, sf):
    return _vocab(spark, sf).select("word", F.array_join(F.array_sort(text.normal_forms("word")), " ").alias("forms"))


@query("b2_strip_accents", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def b2(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.strip_accents("text").alias("folded"))


@query("b3_squash", f"WITH {VOCAB} SELECT word, {fx.sq('word')} AS squashed FROM vocab")
def b3(spark, sf):
    return _vocab(spark, sf).select("word", text.squash("word").alias("squashed"))


@query("b4_trim_edges", f"WITH {VOCAB} SELECT word, {fx.trim_edges_sql('word')} AS trimmed FROM vocab")
def b4(spark, sf):
    return _vocab(spark, sf).select("word", text.trim_edges("word").alias("trimmed"))


def collapse_sql(x: str) -> str:
    """The three collapsed spellings by looking at neighbouring characters (no back references)."""
    cs = f"string_split({x}, '')"
    same = lambda i, j: f"coalesce(cs[i+({i})] = cs[i+({j})], false)"
    first = f"NOT (i > 1 AND {same(0, -1)})"
    run3 = f"((i > 2 AND {same(0, -1)} AND {same(0, -2)}) OR (i > 1 AND {same(0, -1)} AND {same(0, 1)}) OR ({same(0, 1)} AND {same(0, 2)}))"
    one = f"array_to_string(list_filter(cs, lambda c, i: {first}), '')"
    three_one = f"array_to_string(list_filter(cs, lambda c, i: {first} OR NOT {run3}), '')"
    three_two = f"array_to_string(list_filter(cs, lambda c, i: NOT (i > 2 AND {same(0, -1)} AND {same(0, -2)})), '')"
    return cs, one, three_one, three_two


_CS, _ONE, _THREE_ONE, _THREE_TWO = collapse_sql("s")
DEELONGATE_SQL = f"""WITH {VOCAB}, n AS (SELECT DISTINCT {fx.sq('word')} AS s FROM vocab),
c AS (SELECT s, {_CS} AS cs FROM n WHERE s <> ''),
f AS (SELECT s, [{_ONE}, {_THREE_ONE}, {_THREE_TWO}] AS fs FROM c)
SELECT s AS norm, array_to_string(list_sort(list_distinct(list_filter(fs, lambda v: v <> '' AND v <> s))), ' ') AS forms FROM f"""


@query("b5_deelongate", DEELONGATE_SQL)
def b5(spark, sf):
    norms = _vocab(spark, sf).select(text.squash("word").alias("norm")).filter("norm <> ''").distinct()
    return norms.select("norm", F.array_join(F.array_sort(text.deelongate("norm")), " ").alias("forms"))


ROOT_ROWS = f"roots AS (SELECT unnest({list(fx.TERMS)!r}) AS root)"


@query(
    "b6_edit_ratio_levenshtein",
    f"""WITH {VOCAB}, {ROOT_ROWS}, k AS (SELECT DISTINCT {fx.lev_key_sql('word')} AS key FROM vocab)
SELECT key, root, round(s, 6) AS sim FROM (SELECT key, root, {fx.lev_sql('key', 'root')} AS s FROM k, roots
  WHERE 2 * least(length(key), length(root)) >= 0.6 * (length(key) + length(root))) WHERE s >= 0.5""",
)
def b6_lev(spark, sf):
    """Spellings near a listed term under the edit-distance metric."""
    keys = _vocab(spark, sf).select(similarity.lev_key("word").alias("key")).distinct()
    listed = F.array(*[F.lit(t) for t in fx.TERMS])
    bound = lambda r: similarity.length_bound(F.col("key"), r, 0.6)
    near = F.filter(listed, lambda r: bound(r) & (similarity.lev_similarity(F.col("key"), r) >= 0.5))
    rows = keys.select("key", F.explode(near).alias("root"))
    return rows.withColumn("sim", F.round(similarity.lev_similarity("key", "root"), 6))


@query("b6_edit_ratio")
def b6(spark, sf):
    """Indel ratio of every spelling to the listed terms its length lets it resemble."""
    keys = _vocab(spark, sf).select(text.squash("word").alias("key")).distinct()
    listed = F.array(*[F.lit(t) for t in fx.TERMS])
    near = F.filter(listed, lambda r: similarity.length_bound(F.col("key"), r, 0.6))
    rows = keys.select("key", F.explode(near).alias("root"))
    return rows.withColumn("ratio", similarity.edit_ratio("key", "root")).filter("ratio >= 60")


PAIR_SQL = f"""WITH {fx.MIX}, p AS (SELECT DISTINCT word AS a, lead(word) OVER (PARTITION BY track_id ORDER BY pos) AS b FROM mix),
k AS (SELECT a, b, {fx.lev_key_sql('a')} AS ka, {fx.lev_key_sql('b')} AS kb FROM p WHERE b IS NOT NULL)
SELECT a, b, round({fx.lev_sql('ka', 'kb')}, 6) AS sim FROM k"""


def _adjacent(spark, sf):
    from lexiline.operators import blocks

    near = blocks.neighbours(fx.mix_words(spark, sf), ["track_id"], {"b": (F.col("word"), 1)})
    return near.select(F.col("word").alias("a"), "b").filter("b IS NOT NULL").distinct()


@query("b7_word_similarity_levenshtein", PAIR_SQL)
def b7_lev(spark, sf):
    scored = similarity.score_pairs(_adjacent(spark, sf), "a", "b", "levenshtein")
    return scored.select("a", "b", F.round("sim", 6).alias("sim"))


@query("b7_word_similarity")
def b7(spark, sf):
    """Block-matching similarity of all distinct adjacent pairs at 0.6 or more."""
    return similarity.score_pairs(_adjacent(spark, sf), "a", "b", "ratcliff", 0.6).filter("sim >= 0.6")


@query(
    "b8_latin_ratio",
    """WITH l AS (SELECT doc_id, regexp_replace(text, '[^\\p{L}]', '', 'g') AS ls FROM documents)
SELECT doc_id, CASE WHEN length(ls) > 0 THEN round(length(regexp_replace(ls, '[^\\x{0}-\\x{24F}]', '', 'g')) / length(ls), 6) ELSE 0.0 END AS ratio FROM l""",
)
def b8(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.round(text.latin_ratio("text"), 6).alias("ratio"))


TITLE_SQL = """titles AS (SELECT p_partkey, p_brand, p_name, p_type, p_size,
  p_name || CASE p_partkey % 6 WHEN 0 THEN ' (Radio Edit)' WHEN 1 THEN ' [Official Video]' WHEN 2 THEN ' (DJ ' || p_type || ' Remix)'
    WHEN 3 THEN ' (feat. x)' WHEN 4 THEN ' - .' ELSE '' END AS title,
  p_brand || CASE p_partkey % 7 WHEN 0 THEN ' & ' || p_type WHEN 1 THEN ', ' || p_type WHEN 2 THEN ' ft. ' || p_type
    WHEN 3 THEN ' (feat. ' || p_type || ')' WHEN 4 THEN ' Featuring ' || p_type WHEN 5 THEN ' AND x, y' ELSE CASE WHEN p_size % 2 = 0 THEN ' (feat ' ELSE ' (defeats ' END || p_type || ')' END AS artist FROM part)"""


def _titles(spark, sf):
    k = F.col("p_partkey")
    title = F.concat(
        "p_name",
        F.when(k % 6 == 0, " (Radio Edit)").when(k % 6 == 1, " [Official Video]")
        .when(k % 6 == 2, F.concat(F.lit(" (DJ "), "p_type", F.lit(" Remix)"))).when(k % 6 == 3, " (feat. x)")
        .when(k % 6 == 4, " - .").otherwise(""),
    )
    artist = F.concat(
        "p_brand",
        F.when(k % 7 == 0, F.concat(F.lit(" & "), "p_type")).when(k % 7 == 1, F.concat(F.lit(", "), "p_type"))
        .when(k % 7 == 2, F.concat(F.lit(" ft. "), "p_type")).when(k % 7 == 3, F.concat(F.lit(" (feat. "), "p_type", F.lit(")")))
        .when(k % 7 == 4, F.concat(F.lit(" Featuring "), "p_type")).when(k % 7 == 5, " AND x, y")
        .otherwise(F.concat(F.when(F.col("p_size") % 2 == 0, " (feat ").otherwise(" (defeats "), "p_type", F.lit(")"))),
    )
    return fx.table(spark, sf, "part").select("*", title.alias("title"), artist.alias("artist"))


@query(
    "b9_clean_title",
    f"""WITH {TITLE_SQL} SELECT p_partkey, title, CASE p_partkey % 6 WHEN 3 THEN title ELSE p_name END AS cleaned FROM titles""",
)
def b9(spark, sf):
    return _titles(spark, sf).select("p_partkey", "title", text.clean_title("title").alias("cleaned"))


@query("b10_primary_artist", f"WITH {TITLE_SQL} SELECT p_partkey, artist, CASE WHEN p_partkey % 7 = 5 THEN p_brand || ' AND x' WHEN p_partkey % 7 = 6 AND p_size % 2 = 1 THEN artist ELSE p_brand END AS first_artist FROM titles")
def b10(spark, sf):
    return _titles(spark, sf).select("p_partkey", "artist", text.primary_artist("artist").alias("first_artist"))


@query(
    "b11_artist_matches",
    f"WITH {TITLE_SQL} SELECT p_partkey, p_partkey % 3 <> 0 OR contains(lower(artist), lower(p_type)) AS matches FROM titles",
)
def b11(spark, sf):
    """Each credit against its own brand, or against its type where the id is a multiple of three."""
    other = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise(F.col("p_type"))
    t = _titles(spark, sf).withColumn("other", other)
    return t.select("p_partkey", text.artist_matches("artist", "other").alias("matches"))


JUNK_SQL = """names AS (SELECT p_partkey, p_brand, p_name, p_type,
  p_brand || CASE p_partkey % 4 WHEN 0 THEN ' ®' WHEN 1 THEN '_' ELSE '' END || ' - ' || p_name
  || CASE p_partkey % 5 WHEN 0 THEN ' (Official Music Video)' WHEN 1 THEN ' - 05' WHEN 2 THEN ' [HD]' WHEN 3 THEN ' - SiteName.com' ELSE ' 320 kbps' END AS raw
  FROM part)"""


def junk_names(spark, sf):
    k = F.col("p_partkey")
    raw = F.concat(
        "p_brand", F.when(k % 4 == 0, " ®").when(k % 4 == 1, "_").otherwise(""), F.lit(" - "), "p_name",
        F.when(k % 5 == 0, " (Official Music Video)").when(k % 5 == 1, " - 05").when(k % 5 == 2, " [HD]")
        .when(k % 5 == 3, " - SiteName.com").otherwise(" 320 kbps"),
    )
    return fx.table(spark, sf, "part").select("*", raw.alias("raw"))


def junk_sql(x: str) -> str:
    pat = fixed.JUNK
    return rf"regexp_replace(regexp_replace(replace(regexp_replace({x}, '(?i){pat}', ' ', 'g'), '_', ' '), '\s+', ' ', 'g'), '^[ \-–—|]+|[ \-–—|]+$', '', 'g')"


@query("b12_strip_junk", f"WITH {JUNK_SQL} SELECT p_partkey, {junk_sql('raw')} AS cleaned FROM names")
def b12(spark, sf):
    return junk_names(spark, sf).select("p_partkey", text.strip_junk("raw").alias("cleaned"))


def segments_sql(x: str) -> str:
    return (
        rf"list_filter(list_transform(string_split_regex({x}, '\s+[-–—]\s+'), lambda p: {junk_sql('p')}), "
        r"lambda p: p <> '' AND NOT regexp_matches(p, '^[0-9]{1,3}$'))"
    )


@query("b13_split_segments", f"WITH {JUNK_SQL} SELECT p_partkey, array_to_string({segments_sql('raw')}, '|') AS segments FROM names")
def b13(spark, sf):
    return junk_names(spark, sf).select("p_partkey", F.array_join(text.split_segments("raw"), "|").alias("segments"))


BLANKS = "' ' || chr(9) || chr(13) || chr(10)"
PAGE_TEXT = r"pagetext AS (SELECT page_id, trim(regexp_replace(html, '<[^>]*>', ' ', 'g'), {b}) AS body FROM pages)".replace("{b}", BLANKS)


def page_text(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", text.trim_ws(F.regexp_replace("html", "<[^>]*>", " ")).alias("body")
    )


@query("b14_clean_scraped_text", f"WITH {PAGE_TEXT} SELECT page_id, body AS cleaned FROM pagetext")
def b14(spark, sf):
    """Page bodies wrapped in a contributor header and an embed marker, then unwrapped."""
    wrapped = F.concat(F.lit("12 ContributorsTitle\n"), "body", F.when(F.col("page_id") % 2 == 0, "\n7Embed").otherwise("Embed"))
    return page_text(spark, sf).select("page_id", text.clean_scraped_text(wrapped).alias("cleaned"))


@query(
    "b15_effective_censor_type",
    f"""WITH {fx.DENSE}, {fx.TRACKS} SELECT e AS effective, n AS following, count(*) AS n_words FROM (
  SELECT e, CASE e WHEN 'mute' THEN 'beep' WHEN 'beep' THEN 'reverse' WHEN 'reverse' THEN 'tape_stop' END AS n
  FROM (SELECT coalesce(censor_type, default_censor_type) AS e FROM dense JOIN tracks USING (track_id))) GROUP BY ALL""",
)
def b15(spark, sf):
    words = fx.dense_flags(spark, sf).join(fx.tracks(spark, sf).select("track_id", "default_censor_type"), "track_id")
    typed = words.select(
        text.effective_censor_type("censor_type", "default_censor_type").alias("effective"),
        text.next_censor_type("censor_type", "default_censor_type").alias("following"),
    )
    return typed.groupBy("effective", "following").agg(F.count("*").alias("n_words"))


@query(
    "b16_clean_output_name",
    """SELECT p_partkey, replace(p_name, ' ', '.') || '_clean.' || CASE p_size % 3 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' ELSE 'flac' END AS out_name,
  CASE WHEN p_partkey % 2 = 0 THEN p_name || '.ogg' ELSE p_name || '.wav' END AS out_path FROM part""",
)
def b16(spark, sf):
    """File names built from part names (with inner dots); `source` keeps the MP3 extension."""
    p = fx.table(spark, sf, "part").select(
        "p_partkey",
        "p_name",
        F.concat(F.translate("p_name", " ", "."), F.lit(".MP3")).alias("file_name"),
        F.when(F.col("p_size") % 3 == 0, "source").when(F.col("p_size") % 3 == 1, "wav").otherwise("flac").alias("fmt"),
        F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".ogg").otherwise(".txt")).alias("typed"),
    )
    return p.select(
        "p_partkey",
        text.clean_output_name("file_name", "fmt").alias("out_name"),
        text.coerce_output_path("typed", F.lit("wav")).alias("out_path"),
    )


@query(
    "b17_clocks",
    """WITH s AS (SELECT event_id, value * 10 AS sec FROM events),
c AS (SELECT event_id, sec, (floor(sec / 60)::BIGINT)::VARCHAR AS m, sec % 60 AS r FROM s),
o AS (SELECT event_id, m || ':' || lpad((floor(r)::BIGINT)::VARCHAR, 2, '0') AS floored,
  m || ':' || lpad((floor(r + 0.5)::BIGINT)::VARCHAR, 2, '0') AS rounded,
  m || ':' || lpad((floor(r)::BIGINT)::VARCHAR, 2, '0') || '.' || (floor((r - floor(r)) * 10)::BIGINT)::VARCHAR AS tenths, m, r FROM c)
SELECT event_id, floored, rounded, tenths, m::BIGINT * 60 + floor(r) + floor((r - floor(r)) * 10) / 10 AS parsed,
  CASE WHEN event_id % 100 < 60 THEN (event_id % 10 * 60 + event_id % 100)::DOUBLE END AS minutes FROM o""",
)
def b17(spark, sf):
    """Clock renderings of every event value, and parsing of what was rendered."""
    ev = fx.table(spark, sf, "events").select("event_id", (F.col("value") * 10).alias("sec"))
    out = ev.select(
        "event_id",
        text.format_clock("sec", "floor").alias("floored"),
        text.format_clock("sec", "round").alias("rounded"),
        text.format_clock("sec", "tenths").alias("tenths"),
    )
    raw = F.concat((F.col("event_id") % 10).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    return out.withColumn("parsed", text.parse_clock("tenths")).withColumn("minutes", text.parse_clock(raw))


@query(
    "b18_container_family",
    """SELECT ext, family, count(*) AS n FROM (SELECT ext, CASE WHEN ext IN ('mp3', 'wav', 'aif') THEN 'id3' WHEN ext = 'flac' THEN 'flac' WHEN ext = 'm4a' THEN 'mp4' END AS family
  FROM (SELECT ['mp3', 'wav', 'aif', 'flac', 'm4a', 'ogg'][p_partkey % 6 + 1] AS ext FROM part)) GROUP BY ALL""",
)
def b18(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("mp3", "wav", "aif", "flac", "m4a", "ogg")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = fx.table(spark, sf, "part").select(ext.alias("ext"))
    return p.select("ext", text.container_family("ext").alias("family")).groupBy("ext", "family").agg(F.count("*").alias("n"))


@query(
    "b19_map_billing_status",
    f"""SELECT raw, status, count(*) AS n FROM (SELECT raw, CASE WHEN raw IN ('active', 'trialing') THEN 'active' WHEN raw = 'past_due' THEN 'past_due'
  WHEN raw = 'unknown' THEN 'none' ELSE 'canceled' END AS status FROM (SELECT {list(fixed.STATUS_PRIORITY) + ['unknown']!r}[o_orderkey % 9 + 1] AS raw FROM orders)) GROUP BY ALL""",
)
def b19(spark, sf):
    every = F.array(*[F.lit(s) for s in (*fixed.STATUS_PRIORITY, "unknown")])
    o = fx.table(spark, sf, "orders").select(F.element_at(every, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("raw"))
    return o.select("raw", text.map_billing_status("raw").alias("status")).groupBy("raw", "status").agg(F.count("*").alias("n"))


@query(
    "b20_cache_key",
    "SELECT p_partkey, sha1('v2|' || trim(lower(p_brand)) || '|' || trim(lower(p_name)) || '|' || (150 + p_size) || '|') AS key FROM part",
)
def b20(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        text.cache_key("p_brand", F.concat(F.lit(" "), "p_name"), (150 + F.col("p_size")) * 1000 + 400, F.lit(None).cast("string")).alias("key"),
    )
