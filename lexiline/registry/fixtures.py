"""Inputs of the registered queries, derived from the given tables, in Spark and as SQL CTEs.

Both sides follow the same formulas; every derived table covers the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiline.functions import text
from lexiline.sources import tables

TERMS = "trash scum idiot clown worthless moron pathetic loser stupid disgusting".split()
# Frequent adjacent pairs of the sample texts play the part of compounds.
PAIRS = (("of", "the"), ("on", "the"), ("en", "la"))
PAIRS_ES = (("de", "la"),)
GAPS = ("and", "la", "de")
JOINED = ("ofthe", "andthe")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return tables.spread(df) if name == "documents" else df


def lexicon(spark: SparkSession, extra: tuple[str, ...] = ()) -> DataFrame:
    return tables.lexicon_of(spark, [(t, "en", "exact") for t in (*TERMS, *extra)])


def mix_words(spark: SparkSession, sf: str) -> DataFrame:
    """First pass: every token of every document."""
    w = tables.words_from_text(table(spark, sf, "documents"), "doc_id", "text", keep=("lang",))
    return (
        w.withColumnRenamed("lang", "language")
        .withColumn("confidence", ((F.col("pos") * 7 + F.col("track_id") * 13) % 100) / 100.0)
        .withColumn("is_profanity", F.lit(False))
        .withColumn("detection_source", F.lit(None).cast("string"))
    )


def flagged_words(spark: SparkSession, sf: str) -> DataFrame:
    """First pass with the listed terms flagged."""
    return mix_words(spark, sf).withColumn("is_profanity", text.squash("word").isin(*TERMS))


def stem_words(spark: SparkSession, sf: str) -> DataFrame:
    """Second pass: every fifth token, 120 ms later, its own confidence."""
    w = mix_words(spark, sf).filter(F.col("pos") % 5 == 0)
    return (
        w.withColumn("start_ms", F.col("start_ms") + 120)
        .withColumn("end_ms", F.col("end_ms") + 120)
        .withColumn("confidence", ((F.col("pos") * 11 + F.col("track_id")) % 100) / 100.0)
        .withColumn("is_profanity", text.squash("word").isin(*TERMS))
    )


def overlapping_words(spark: SparkSession, sf: str) -> DataFrame:
    """First pass with longer words: some overlap their successor."""
    w = flagged_words(spark, sf)
    return w.withColumn("end_ms", F.col("start_ms") + 300 + (F.col("pos") % 4) * 150)


def dense_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping words where every ninth is flagged too, with mixed types and sources."""
    w = overlapping_words(spark, sf)
    return (
        w.withColumn("is_profanity", F.col("is_profanity") | (F.col("pos") % 9 == 0))
        .withColumn("censor_type", F.when(F.col("pos") % 4 == 0, "beep").when(F.col("pos") % 27 == 0, "reverse"))
        .withColumn(
            "detection_source",
            F.when(F.col("pos") % 5 == 0, "lyrics").when(F.col("pos") % 7 == 0, "hook_echo").when(
                F.col("pos") % 11 == 0, "vocals"
            ),
        )
    )


STATUSES = ("pending", "transcribing", "separating", "ready", "completed")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: duration from the token count, status and default type by id."""
    docs = table(spark, sf, "documents")
    n = F.size(F.filter(F.split("text", r"[ \n\t]+"), lambda t: t != ""))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("track_id"),
        F.concat(F.lit("track_"), F.col("doc_id"), F.lit(".mp3")).alias("file_name"),
        (n * 400).cast("long").alias("duration_ms"),
        F.col("lang").alias("language"),
        status.alias("status"),
        F.when(F.col("doc_id") % 3 == 0, "beep").otherwise("mute").alias("default_censor_type"),
        (F.col("doc_id") % 50).alias("uid"),
    )


def styled_words(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicon hits respelt: a third as they are, a third masked, a third elongated."""
    w = mix_words(spark, sf).withColumn("s", text.squash("word"))
    masked = F.concat(F.substring("s", 1, 1), F.repeat(F.lit("*"), F.length("s") - 2), F.substring(F.col("s"), F.length("s"), F.lit(1)))
    elongated = F.concat(F.substring("s", 1, 1), F.repeat(F.substring("s", 2, 1), F.lit(3)), F.substring(F.col("s"), F.lit(3), F.length("s")))
    hit = F.col("s").isin(*TERMS)
    word = (
        F.when(hit & (F.col("pos") % 3 == 1), masked).when(hit & (F.col("pos") % 3 == 2), elongated).otherwise(F.col("word"))
    )
    return w.withColumn("word", word).drop("s")


def misheard_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every eleventh token of at least five characters loses its last character to an x."""
    w = flagged_words(spark, sf)
    wrong = F.concat(F.substring(F.col("word"), F.lit(1), F.length("word") - 1), F.lit("x"))
    hit = (F.col("pos") % 11 == 0) & (F.length("word") >= 5)
    return w.withColumn("word", F.when(hit, wrong).otherwise(F.col("word")))


def lrc_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as timed text: each line stamped with the start of its first token."""
    docs = table(spark, sf, "documents")
    lines = F.split("text", "\n")
    size = lambda l: F.size(F.filter(F.split(l, r"[ \t]+"), lambda t: t != ""))
    stamped = F.aggregate(
        lines,
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("out")),
        lambda acc, l: F.struct(
            (acc["n"] + size(l)).cast("long").alias("n"),
            F.concat(acc["out"], F.array(F.concat(_stamp(acc["n"] * 400), F.lit(" "), l))).alias("out"),
        ),
        lambda acc: F.array_join(acc["out"], "\n"),
    )
    return docs.select(F.col("doc_id").alias("track_id"), "lang", stamped.alias("lrc"))


def _stamp(ms):
    sec = F.floor((ms % 60_000) / 1000)
    return F.concat(
        F.lit("["), F.floor(ms / 60_000).cast("string"), F.lit(":"), F.lpad(sec.cast("string"), 2, "0"), F.lit("."),
        F.lpad((F.floor(ms % 1000 / 10)).cast("string"), 2, "0"), F.lit("]"),
    )


def timed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tables.parse_timed_lines(lrc_docs(spark, sf), "track_id", "lrc")


def ref_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The trusted text: a document's tokens without every seventh, renumbered."""
    w = mix_words(spark, sf).filter(F.col("pos") % 7 != 6)
    pos = F.col("pos") - F.floor((F.col("pos") + 1) / 7)
    return w.select("track_id", pos.alias("pos"), text.trim_edges("word").alias("token")).filter(F.col("token") != "")


# --- the same tables as SQL -------------------------------------------------------------

WCLASS = r"\p{L}\p{N}_"


def sq(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^{WCLASS}]', '', 'g'))"


def trim_edges_sql(x: str) -> str:
    e = WCLASS + "''*@$"
    return f"regexp_replace({x}, '^[^{e}]+|[^{e}]+$', '', 'g')"


def lev_key_sql(x: str) -> str:
    return f"replace(strip_accents({sq(x)}), 'ß', 'ss')"


def lev_sql(a: str, b: str) -> str:
    """Similarity of two accent-free keys."""
    return f"(CASE WHEN greatest(length({a}), length({b})) > 0 THEN 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE ELSE 0.0 END)"


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


LEX = f"lexicon AS (SELECT unnest({list(TERMS)!r}) AS term)"
TOKS = (
    "toks AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda t: t <> '') AS ts "
    "FROM documents)"
)
MIX = (
    TOKS
    + """, mix0 AS (SELECT doc_id AS track_id, lang AS language, unnest(ts) AS word, generate_subscripts(ts, 1) - 1 AS pos FROM toks),
mix AS (SELECT track_id, language, word, pos::BIGINT AS pos, (pos * 400)::BIGINT AS start_ms, (pos * 400 + 300)::BIGINT AS end_ms,
  ((pos * 7 + track_id * 13) % 100) / 100.0::DOUBLE AS confidence FROM mix0)"""
)
FLAGGED = MIX + f", flagged AS (SELECT *, {sq('word')} IN {in_list(TERMS)} AS is_profanity FROM mix)"
OVERLAP = FLAGGED + (
    ", overlap AS (SELECT track_id, language, word, pos, start_ms, start_ms + 300 + (pos % 4) * 150 AS end_ms, confidence, "
    "is_profanity FROM flagged)"
)
DENSE = OVERLAP + """, dense AS (SELECT track_id, language, word, pos, start_ms, end_ms, confidence,
  is_profanity OR pos % 9 = 0 AS is_profanity,
  CASE WHEN pos % 4 = 0 THEN 'beep' WHEN pos % 27 = 0 THEN 'reverse' END AS censor_type,
  CASE WHEN pos % 5 = 0 THEN 'lyrics' WHEN pos % 7 = 0 THEN 'hook_echo' WHEN pos % 11 = 0 THEN 'vocals' END AS detection_source
  FROM overlap)"""
STEM = (
    ", stem AS (SELECT track_id, language, word, pos, start_ms + 120 AS start_ms, end_ms + 120 AS end_ms, "
    "((pos * 11 + track_id) % 100) / 100.0::DOUBLE AS confidence, is_profanity FROM flagged WHERE pos % 5 = 0)"
)
TRACKS = """tracks AS (SELECT doc_id AS track_id, 'track_' || doc_id || '.mp3' AS file_name,
  (len(list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda t: t <> '')) * 400)::BIGINT AS duration_ms, lang AS language,
  ['pending', 'transcribing', 'separating', 'ready', 'completed'][doc_id % 5 + 1] AS status,
  CASE WHEN doc_id % 3 = 0 THEN 'beep' ELSE 'mute' END AS default_censor_type, doc_id % 50 AS uid FROM documents)"""
STYLED = MIX + f""", styled AS (SELECT track_id, language, pos, start_ms, end_ms, confidence,
  CASE WHEN s IN {in_list(TERMS)} AND pos % 3 = 1 THEN left(s, 1) || repeat('*', (length(s) - 2)::BIGINT) || right(s, 1)
       WHEN s IN {in_list(TERMS)} AND pos % 3 = 2 THEN left(s, 1) || repeat(s[2], 3) || substr(s, 3)
       ELSE word END AS word FROM (SELECT *, {sq('word')} AS s FROM mix))"""
MISHEARD = FLAGGED + """, misheard AS (SELECT track_id, language, pos, start_ms, end_ms, confidence, is_profanity,
  CASE WHEN pos % 11 = 0 AND length(word) >= 5 THEN left(word, length(word) - 1) || 'x' ELSE word END AS word FROM flagged)"""
# Lines of a document, the running token count before each, and its stamp.
LINES = """raw_lines AS (SELECT doc_id AS track_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ln
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
line_sizes AS (SELECT *, len(list_filter(string_split_regex(line, '[ \\t]+'), lambda t: t <> '')) AS n FROM raw_lines),
line_starts AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY track_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 400 AS ms
  FROM line_sizes),
lines AS (SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY ln) - 1)::BIGINT AS line_no,
  (ms // 10 * 10)::BIGINT AS time_ms, trim(line, ' ' || chr(9) || chr(13) || chr(10)) AS text
  FROM line_starts WHERE trim(line, ' ' || chr(9) || chr(13) || chr(10)) <> '')"""
REF = f"""ref AS (SELECT track_id, pos - (pos + 1) // 7 AS pos, {trim_edges_sql('word')} AS token FROM mix
  WHERE pos % 7 <> 6 AND {trim_edges_sql('word')} <> '')"""

LINE_WORDS = LINES + f""", lw AS (SELECT track_id, line_no, time_ms, least(coalesce(lead(time_ms) OVER (PARTITION BY track_id ORDER BY line_no), time_ms + 5000) - time_ms, 5000) AS dur_ms,
  list_filter(string_split_regex(text, '[ \\t]+'), lambda x: x <> '') AS ws FROM lines),
lineword AS (SELECT track_id, line_no, i - 1 AS word_no, ws[i] AS raw, {trim_edges_sql('ws[i]')} AS word, round(time_ms + (i - 1) * slot)::BIGINT AS start_ms,
  round(time_ms + (i - 1) * slot + least(slot, 350.0))::BIGINT AS end_ms, time_ms, dur_ms, len(ws) AS line_words
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i, dur_ms::DOUBLE / greatest(len(ws), 1)::DOUBLE AS slot FROM lw))"""
