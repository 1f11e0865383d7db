"""Readers, writers and parsers: from files and raw text to the tables of `schemas`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexiline import fixed, schemas, session
from lexiline.functions import text
from lexiline.operators import blocks

_RAW_WORDS = (
    "track_id BIGINT, pass STRING, word STRING, start DOUBLE, end DOUBLE, confidence DOUBLE, is_profanity BOOLEAN, "
    "detection_source STRING, censor_type STRING, original_word STRING, correction_confidence DOUBLE"
)


#: Rows of one JSON file of words: a compressed file is read by one task.
FILE_ROWS = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input has fewer splits than the session has cores.

    Large tables have many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def to_ms(seconds) -> Column:
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.round(c * 1000).cast("long")


def read_words(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Word timelines: JSON lines with times in seconds, or parquet written by `write_words`.

    Rows keep the source order as `word_id` where the file has none.
    """
    if fmt == "parquet":
        return schemas.conform_words(spark.read.parquet(path))
    raw = spark.read.schema(_RAW_WORDS + ", word_id BIGINT, pos BIGINT").json(path)
    raw = raw.withColumn("start_ms", to_ms("start")).withColumn("end_ms", to_ms("end"))
    raw = raw.withColumn("word_id", F.coalesce("word_id", "pos", F.monotonically_increasing_id()))
    return schemas.conform_words(raw)


def write_words(words: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a timeline. JSON output uses seconds, like the input format; its files are compressed and so short that many tasks can read them."""
    if fmt == "json":
        out = words.withColumn("start", F.col("start_ms") / 1000).withColumn("end", F.col("end_ms") / 1000)
        out.drop("start_ms", "end_ms").write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(path)
    else:
        words.write.mode(mode).parquet(path)


def write_regions(regions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist regions partitioned by the type, the column that edit jobs select on."""
    regions.write.mode(mode).partitionBy("censor_type").parquet(path)


def words_from_text(
    docs: DataFrame, id_col: str, text_col: str, step_ms: int = 400, length_ms: int = 300, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Documents as timed words: token k starts at k*step_ms."""
    tokens = F.filter(F.split(F.col(text_col), r"[ \n\t]+"), lambda t: t != "")
    rows = docs.select(F.col(id_col).alias("track_id"), *keep, F.posexplode(tokens).alias("pos", "word"))
    start = F.col("pos").cast("long") * step_ms
    return rows.select(
        "track_id",
        *keep,
        F.col("pos").cast("long").alias("word_id"),
        F.col("pos").cast("long").alias("pos"),
        "word",
        start.alias("start_ms"),
        (start + length_ms).alias("end_ms"),
    )


STAMP = r"^\[([0-9]+):([0-9]+\.[0-9]+)\][ \t]*(.*)"


def parse_timed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`[m:s.fff] text` lines. The seconds need a fraction; empty and malformed lines are dropped."""
    lines = F.transform(F.split(text.trim_ws(text_col), "\n"), text.trim_ws)
    parsed = F.transform(
        F.filter(lines, lambda l: l.rlike(STAMP) & (text.trim_ws(F.regexp_extract(l, STAMP, 3)) != "")),
        lambda l: F.struct(
            (
                F.regexp_extract(l, STAMP, 1).cast("long") * 60_000
                + F.round(F.regexp_extract(l, STAMP, 2).cast("double") * 1000).cast("long")
            ).alias("time_ms"),
            text.trim_ws(F.regexp_extract(l, STAMP, 3)).alias("text"),
        ),
    )
    rows = docs.select(F.col(id_col).alias("track_id"), F.posexplode(parsed).alias("line_no", "l"))
    return rows.select("track_id", F.col("line_no").cast("long").alias("line_no"), "l.time_ms", "l.text")


def tokenize_reference(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Reference text as (line_no, pos, token): edges trimmed, empties dropped, `pos` dense per text."""
    trimmed = F.transform(F.split(text.trim_ws(text_col), "\n"), lambda l: F.split(l, r"[ \t\r]+"))
    flat = F.flatten(
        F.transform(
            trimmed,
            lambda ws, i: F.transform(
                ws, lambda t: F.struct(i.cast("long").alias("line_no"), text.trim_edges(t).alias("token"))
            ),
        )
    )
    kept = F.filter(flat, lambda s: s["token"] != "")
    rows = docs.select(F.col(id_col).alias("track_id"), F.posexplode(kept).alias("pos", "s"))
    return rows.select("track_id", "s.line_no", F.col("pos").cast("long").alias("pos"), "s.token")


#: The wildcard token, and what scraped pages leave in a text (first line, any line, end).
STAR = "<star>"
PAGE_HEADER = r"^[ \t]*[0-9]+[ \t]+Contributor"
PAGE_INSERT = "you might also like"
PAGE_END = r"[0-9]*Embed[ \t\r\n]*$"
SECTION = r"^[ \t\r]*\[[^\n]*\][ \t\r]*$"


def alignment_form(c) -> Column:
    """A token in the letters a to z with apostrophes inside words; `STAR` for what cannot be spelled so (digits, other scripts, marks alone)."""
    folded = text.strip_accents(F.lower(F.regexp_replace(c, "[’‘]", "'")))
    bare = F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}\p{M}']", ""), r"^'+|'+$", "")
    return F.when(bare.rlike("^[a-z]+('[a-z]+)*$"), bare).otherwise(F.lit(STAR))


def normalize_reference(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Reference text as tokens (track_id, pos, line_no, raw, norm, char_start, char_end, is_adlib).

    Section headers (lines in square brackets) and what scraped pages add are left out; `raw` stands at `char_start` up to `char_end` of
    the text as it came. Words in round brackets are ad-libs, also over several lines: the depth before a token is a running sum that
    never falls below zero, so a stray closing bracket changes nothing, and one that is never closed reaches to the end of the text.
    Lines that are left out open and close nothing. `norm` is `alignment_form`; `pos` is dense per text. A null or empty text has no tokens,
    nor has one without an id; texts that share an id are numbered together.
    """
    ids = docs.select(F.col(id_col).alias("track_id")).filter("track_id is not null").groupBy("track_id").count()
    repeated = ids.filter("count > 1").select("track_id")
    src = spread(docs).select(F.col(id_col).alias("track_id"), F.split(F.regexp_replace(text_col, PAGE_END, ""), "\n").alias("__lines")).filter("track_id is not null")

    def line(l, i):
        gone = l.rlike(SECTION) | (F.lower(text.trim_ws(l)) == PAGE_INSERT) | ((i == 0) & l.rlike(PAGE_HEADER))
        return F.struct(i.cast("long").alias("line_no"), gone.alias("gone"), F.concat(l, F.lit("\n")).alias("l"))

    def pieces(s):
        # each piece ends with one separator, so that lengths add up to places in the text
        found = F.regexp_extract_all(s["l"], F.lit(r"[^ \t\r\n]*[ \t\r\n]"), F.lit(0))
        return F.transform(found, lambda p: piece(s["line_no"], s["gone"], p, text.rtrim_ws(p)))

    def piece(line_no, gone, p, raw):
        kept = ~gone & (raw != "")
        step = F.length(F.translate(raw, ")", "")) - F.length(F.translate(raw, "(", ""))
        return F.struct(line_no.alias("line_no"), F.length(p).alias("n"), raw.alias("raw"), kept.alias("kept"), F.when(kept, step).otherwise(0).alias("step"))

    lines = src.select("track_id", F.transform("__lines", line).alias("__lines"))
    cut = lambda df: df.select("track_id", F.flatten(F.transform("__lines", pieces)).alias("__s"))
    if repeated.isEmpty():
        rows = _in_place(cut(lines))
    else:
        # Texts that share an id are numbered as one, so their pieces have to meet.
        once, more = lines.join(repeated, "track_id", "left_anti"), lines.join(repeated, "track_id", "left_semi")
        rows = _in_place(cut(once)).unionByName(_in_blocks(cut(more)))
    return rows.select(
        "track_id", "pos", "line_no", "raw", alignment_form(F.col("raw")).alias("norm"),
        F.col("start").alias("char_start"), (F.col("start") + F.length("raw")).alias("char_end"), ((F.col("before") > 0) | F.col("raw").contains("(")).alias("is_adlib"),
    )


LONGS = T.ArrayType(T.LongType())
RUNNING = T.StructType([T.StructField(c, LONGS) for c in ("pos", "start", "before")])


@F.pandas_udf(RUNNING)
def _running(n: pd.Series, kept: pd.Series, step: pd.Series) -> pd.DataFrame:
    """Place among the kept pieces, place in the text and depth of brackets before each piece of a text."""
    out = []
    for lengths, keeps, steps in zip(n, kept, step):
        if lengths is None:
            out.append((None, None, None))
            continue
        ends, after = np.cumsum(lengths, dtype=np.int64), np.cumsum(steps, dtype=np.int64)
        lowest = np.minimum.accumulate(np.concatenate(([0], after)))[:-1]
        out.append((np.cumsum(keeps, dtype=np.int64) - 1, ends - lengths, after - steps - lowest))
    return pd.DataFrame(out, columns=["pos", "start", "before"])


def _in_place(texts: DataFrame) -> DataFrame:
    """Kept pieces of texts with unlike ids: what runs along a text is computed in its row, nothing moves."""
    of = lambda f: F.transform("__s", lambda s: s[f])
    rows = texts.withColumn("__r", _running(of("n"), of("kept"), of("step")))
    rows = rows.select("track_id", F.explode(F.arrays_zip("__s", "__r.pos", "__r.start", "__r.before")).alias("z"))
    rows = rows.filter("z.__s.kept")
    return rows.select("track_id", "z.__s.line_no", "z.__s.raw", "z.pos", "z.start", "z.before")


def _in_blocks(texts: DataFrame) -> DataFrame:
    """The same for texts that share an id, by scans over blocks of pieces."""
    rows = texts.select("track_id", F.posexplode("__s").alias("__i", "__s")).select("track_id", "__i", "__s.*")
    sums = {"__end": ("sum", F.col("n").cast("long")), "__pos": ("sum", F.col("kept").cast("long")), "__depth": ("sum", F.col("step").cast("long"))}
    # The scans read their input more than once; storing it keeps texts from being cut up again.
    rows = session.cut_lineage(blocks.scan(session.cut_lineage(rows), ["track_id"], ["__i"], sums, width=blocks.CHUNK).filter("kept"))
    rows = blocks.scan(rows, ["track_id"], ["__i"], {"__below": ("max_before", -F.col("__depth"))}, width=blocks.CHUNK)
    before = F.col("__depth") - F.col("step") + F.greatest(F.coalesce("__below", F.lit(0).cast("long")), F.lit(0).cast("long"))
    return rows.select("track_id", "line_no", "raw", (F.col("__pos") - 1).alias("pos"), (F.col("__end") - F.col("n")).alias("start"), before.alias("before"))


def alignable(tokens: DataFrame) -> DataFrame:
    """The tokens of `normalize_reference` that can be spelled, as a reference for `align`: `token`, a dense `pos`, and `ref_pos`, the place among all."""
    spelled = tokens.filter(F.col("norm") != STAR).withColumn("ref_pos", F.col("pos")).withColumn("token", F.col("norm"))
    return blocks.dense_pos(spelled, ["track_id"], ["ref_pos"], width=blocks.CHUNK)


def read_lexicon(spark: SparkSession, path: str, lang: str, tier: str = "exact") -> DataFrame:
    """A term list: one term per line; blank lines and lines that begin with # are skipped."""
    return lexicon_lines(spark.read.text(path), "value", lang, tier)


def lexicon_lines(lines: DataFrame, col: str, lang: str, tier: str = "exact") -> DataFrame:
    term = text.trim_ws(col)
    kept = lines.filter((term != "") & ~F.col(col).startswith("#"))
    return kept.select(F.lower(term).alias("term"), F.lit(lang).alias("lang"), F.lit(tier).alias("tier")).distinct()


def lexicon_of(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A lexicon from (term, lang, tier) literals: a constant of known size in the plan."""
    items = [F.struct(F.lit(t.lower()).alias("term"), F.lit(l).alias("lang"), F.lit(r).alias("tier")) for t, l, r in rows]
    return spark.range(1).select(F.explode(F.array(*items)).alias("e")).select("e.*")


def default_lexicon(spark: SparkSession, extra: list[str] | None = None) -> DataFrame:
    """The built-in extra terms of both languages and the roots, plus the caller's terms."""
    rows = [(t, "en", "exact") for t in (*fixed.EXTRA_TERMS_EN, *fixed.WILDCARD_ROOTS)]
    rows += [(t, "es", "exact") for t in fixed.EXTRA_TERMS_ES]
    rows += [(t, "en", "exact") for t in extra or []]
    return lexicon_of(spark, sorted(set(rows)))


CATALOG_RESULT = "STRUCT<artistName: STRING, trackName: STRING, duration: DOUBLE, plainLyrics: STRING, syncedLyrics: STRING>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Search responses (`{query_id, results:[...]}` per line) as ranked catalog rows."""
    raw = spark.read.schema(f"query_id BIGINT, results ARRAY<{CATALOG_RESULT}>").json(path)
    return catalog_rows(raw)


def catalog_rows(raw: DataFrame) -> DataFrame:
    """Rank order kept as `rank`; entries with neither plain nor timed text are unusable."""
    rows = raw.select("query_id", F.posexplode("results").alias("rank", "r"))
    usable = (F.coalesce("r.plainLyrics", F.lit("")) != "") | (F.coalesce("r.syncedLyrics", F.lit("")) != "")
    return rows.filter(usable).select(
        F.col("query_id").alias("entry_id"),
        F.col("r.artistName").alias("artist"),
        F.col("r.trackName").alias("title"),
        to_ms("r.duration").alias("duration_ms"),
        F.col("r.plainLyrics").alias("plain"),
        F.col("r.syncedLyrics").alias("synced"),
        F.col("rank").cast("long").alias("rank"),
    )


def parse_probe_log(logs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Media-probe text: duration, container bit rate and the first audio stream's fields."""
    log = F.col(text_col)
    dur = r"Duration:\s*([0-9]+):([0-9]+):([0-9]+\.[0-9]+)"
    has_dur = log.rlike(dur)
    duration_ms = F.when(
        has_dur,
        F.regexp_extract(log, dur, 1).try_cast("long") * 3_600_000
        + F.regexp_extract(log, dur, 2).try_cast("long") * 60_000
        + F.round(F.regexp_extract(log, dur, 3).try_cast("double") * 1000).cast("long"),
    )
    stream = r"Stream #([0-9]+):([0-9]+)[^:\n]*: Audio:[ \t]*([^\n]+)"
    has_stream = log.rlike(stream)
    parts = F.transform(F.split(F.regexp_extract(log, stream, 3), ", "), text.trim_ws)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def last_of(pred, value):
        # A later field of the same kind replaces an earlier one.
        return F.element_at(F.transform(F.filter(rest, pred), value), -1)

    layouts = F.create_map(*[F.lit(x) for kv in fixed.CHANNEL_LAYOUTS.items() for x in kv])
    is_rate = lambda p: p.endswith("Hz")
    is_bits = lambda p: p.endswith("kb/s")
    is_layout = lambda p: ~is_rate(p) & ~is_bits(p) & F.lower(p).isin(*fixed.CHANNEL_LAYOUTS)
    is_fmt = lambda p: p.rlike(r"^[su][0-9]+p?$") | p.isin(*fixed.FLOAT_FORMAT_BITS)
    some = lambda pred: F.exists(rest, pred)
    fmt = F.when(some(is_fmt), last_of(is_fmt, lambda p: p)).otherwise(F.lit(""))
    bits = (
        F.when(fmt.isin("flt", "fltp"), 32)
        .when(fmt.isin("dbl", "dblp"), 64)
        .otherwise(F.coalesce(F.regexp_extract(fmt, r"([0-9]+)", 1).try_cast("int"), F.lit(0)))
    )
    rate = F.when(some(is_rate), last_of(is_rate, lambda p: F.regexp_extract(p, r"([0-9]+)\s*Hz", 1).try_cast("int")))
    channels = F.when(some(is_layout), last_of(is_layout, lambda p: F.element_at(layouts, F.lower(p))))
    stream_rate = F.when(
        some(is_bits), last_of(is_bits, lambda p: F.regexp_extract(p, r"([0-9]+)\s*kb/s", 1).try_cast("long") * 1000)
    )
    codec = F.regexp_replace(F.element_at(F.split(F.element_at(parts, 1), r"\s+"), 1), ",+$", "")
    return logs.select(
        F.col(id_col),
        duration_ms.alias("duration_ms"),
        (F.regexp_extract(log, r"bitrate:\s*([0-9]+)\s*kb/s", 1).try_cast("long") * 1000).alias("bit_rate"),
        F.when(has_stream, F.regexp_extract(log, stream, 2).try_cast("int")).alias("stream_index"),
        F.when(has_stream, codec).alias("codec"),
        F.when(has_stream, F.coalesce(rate, F.lit(44100))).alias("sample_rate"),
        F.when(has_stream, F.coalesce(channels, F.lit(2))).alias("channels"),
        F.when(has_stream, bits).alias("bits_per_sample"),
        F.when(has_stream, stream_rate).alias("stream_bit_rate"),
    )


APP_EVENT = (
    "client_id STRING, events ARRAY<STRUCT<name: STRING, params: STRUCT<session_id: STRING, "
    "engagement_time_msec: STRING, method: STRING, duration: DOUBLE, count: DOUBLE>>>, received_at TIMESTAMP"
)


def flatten_app_events(posts: DataFrame) -> DataFrame:
    """Event posts as one row per event; works on batch and streaming input alike."""
    rows = posts.select("client_id", "received_at", F.explode("events").alias("e"))
    return rows.select("client_id", F.col("received_at").alias("ts"), F.col("e.name").alias("name"), "e.params.*")


def read_app_event_stream(spark: SparkSession, path: str) -> DataFrame:
    return flatten_app_events(spark.readStream.schema(APP_EVENT).json(path))


def read_event_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The events table as a stream: UTC timestamps, JSON properties parsed."""
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return typed_events(raw)


def typed_events(raw: DataFrame) -> DataFrame:
    props = F.from_json("props", "k BIGINT")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", props["k"])


def exports(words: DataFrame, tracks: DataFrame) -> DataFrame:
    """One export-history row per track that has words."""
    counts = words.groupBy("track_id").agg(
        F.count("*").alias("word_count"), F.count_if("is_profanity").alias("profanity_count")
    )
    return tracks.join(counts, "track_id").select(
        "track_id",
        F.col("file_name").alias("original_file_name"),
        text.clean_output_name("file_name", F.lit("source")).alias("censored_file_name"),
        "exported_at",
        "word_count",
        "profanity_count",
        "duration_ms",
        "language",
    )


def append_exports(words: DataFrame, tracks: DataFrame, path: str) -> None:
    exports(words, tracks).write.mode("append").parquet(path)
