"""Benchmark decontamination by canonical templates, in built-in expressions only.

Numbers, units after numbers and names become typed placeholders; the other words are lower-cased. Texts are read twice:
with capitalised words inside a sentence as names, and with all capitalised words as names, where neighbouring names and the words
of one unit are one placeholder. Either reading may find a match; where both do, the first one is reported. All windows of `WINDOW` canonical words of the benchmark and of the documents are
joined by hash, so that any shared run of `WINDOW` words is found wherever it begins; an item of fewer words is a window of its own
length, and the documents are cut into windows of that length too. A match is then checked in place: item and document are aligned word by word, under the shift of a shared window and, where that
one disagrees, under those of other shared windows up to `DRIFT` words away, and

* canonical words agree at `RUN` positions or more, or at all of a shorter item,
* at least `SHARE` of the item's words agree,
* slots are consistent: equal values of the item stand for equal values of the document.

So a question that was only given other numbers, names or units is caught, while a text that shares the form of
a question but uses its slots otherwise is not.

Texts that cannot match are put aside first, by a necessary condition: a plain word is a whole run of letters, and plain words side
by side are runs of letters side by side in the text, whatever the reading. Of each wanted window the `ANCHOR` neighbouring
plain words with the most letters (fewer where there are no more) are its anchor; only texts that hold an anchor are read and cut into windows.

Cases: null or empty texts match nothing; items of equal text are
compared once and all reported; documents of equal text are compared once and reported alike, null and repeated ids included; extra
columns are ignored by `matches` and kept by `clean`. `clean` removes rows by id and text, so that another text under the same id stays. Windows of placeholders alone are ignored (`LITERALS` plain words at least), and so are items without
such a window. A match without a shared run of `WINDOW` words is not found.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiline.llm.common import shuffle_partitions, stored

WINDOW = 8
ANCHOR = 5
#: So many anchors (100 bytes or so each) are sent to every task; more are joined by a shuffle.
FEW_ANCHORS = 100_000
RUN = 13
SHARE = 0.8
LITERALS = 3
DRIFT = 6
UNITS = (
    "km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "sec", "min", "h", "hours", "hour", "minutes", "minute", "seconds",
    "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "miles", "mile", "feet", "foot", "inches",
    "inch", "meters", "meter", "metres", "metre", "kilometers", "kilograms", "grams", "liters", "litres", "pounds", "pound",
    "ounces", "dollars", "dollar", "euros", "euro", "cents", "percent", "degrees", "mph",
)
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
NAME_AT = r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{L}+)"
ANY_NAME_AT = r"(?<![\p{L}\p{N}\x04])(\p{Lu}[\p{L}\x04]+)"
NEXT_NAME_AT = r" (?=\p{Lu}\p{L})(?<=(?<![\p{L}\p{N}])\p{Lu}\p{L}{1,60} )"
NUMBER_AT = r"(\p{N}+(?:[.,:]\p{N}+)*)"
UNIT_AT = rf"({NUMBER}\p{{N}}[\p{{N}}.,:]* ?)({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)"
MANY = "|".join(UNITS)
RATE_AT = rf"(?<![\p{{L}}\p{{N}}])({MANY})(?: (per) |/)({MANY})(?![\p{{L}}\p{{N}}])"
SIZES = ("square", "cubic", "nautical", "fluid")
SIZE_AT = rf"(?<![\p{{L}}\p{{N}}])({'|'.join(SIZES)}) (?=(?:{MANY})(?![\p{{L}}\p{{N}}]))"
LONG_UNIT_AT = rf"({NUMBER}\p{{N}}[\p{{N}}.,:]* *)((?:(?:square|cubic|nautical|fluid)\x04)?(?:{MANY})(?:\x04per\x04(?:{MANY})|\x04(?:{MANY}))?)([^\p{{L}}\p{{N}}\x04]|$)"
GAP = r"[^\p{L}\p{N}\x01\x02\x03]+"
JOINT = "\u0004"
READINGS = (False, True)
LETTERS = r"[^\p{L}]+"


def tagged(text: Column, joined: bool = False) -> Column:
    """The text with a mark before each name, number and unit."""
    if joined:
        # the two dear patterns are only tried where a text has what they need
        plain = F.regexp_replace(text, "[\u0001-\u0004]", " ")
        rate = F.contains(plain, F.lit(" per ")) | F.contains(plain, F.lit("/"))
        size = reduce(or_, (F.contains(plain, F.lit(f"{kind} ")) for kind in SIZES))
        out = F.regexp_replace(plain, NEXT_NAME_AT, JOINT)
        out = F.when(rate, F.regexp_replace(F.regexp_replace(out, RATE_AT, f"$1{JOINT}$2{JOINT}$3"), f"{JOINT}{JOINT}", JOINT)).otherwise(out)
        out = F.when(size, F.regexp_replace(out, SIZE_AT, f"$1{JOINT}")).otherwise(out)
        out = F.regexp_replace(out, ANY_NAME_AT, f"{NAME}$1")
        return F.regexp_replace(F.regexp_replace(out, NUMBER_AT, f" {NUMBER}$1 "), LONG_UNIT_AT, f"$1 {UNIT}$2$3")
    out = F.regexp_replace(F.regexp_replace(text, "[\u0001-\u0003]", " "), NAME_AT, f"{NAME}$1")
    return F.regexp_replace(F.regexp_replace(out, NUMBER_AT, f" {NUMBER}$1 "), UNIT_AT.replace(" ?)(", " *)("), f"$1 {UNIT}$2$3")


def words_in(text: Column, joined: bool) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP.replace("]+", r"\x04]+") if joined else GAP), "")


def values(text: Column, joined: bool = False) -> Column:
    """Words of the text in order, placeholders with their values."""
    return words_in(F.regexp_replace(tagged(text, joined), r"(?<=\p{N})[.,:](?=\p{N})", ""), joined)


def canonical(text: Column, joined: bool = False) -> Column:
    """Words of the text in order, placeholders without their values."""
    return words_in(F.regexp_replace(tagged(text, joined), rf"([{NAME}{UNIT}])[\p{{L}}\x04]+|({NUMBER})\p{{N}}[\p{{N}}.,:]*", "$1$2"), joined)


def readings(text: Column, *parts) -> Column:
    """An array of both readings: (joined, one column for each of the parts)."""
    return F.array(*(F.struct(F.lit(j).alias("joined"), *(p(text, j).alias(p.__name__) for p in parts)) for j in READINGS))


def n_words(found: Column) -> Column:
    """Words of the text that some values stand for."""
    whole = F.array_join(found, " ")
    return F.size(found) + F.length(whole) - F.length(F.replace(whole, F.lit(JOINT), F.lit("")))


def windows(words: Column, size: Column) -> Column:
    """(at, hash) of all windows of so many words."""
    last = F.size(words) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, size)).alias("hash")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the distinct item texts that hold enough plain words: (item_key, joined, size, at, hash, plain)."""
    items = benchmark.filter("text is not null").select(F.col("text").alias("item_text")).distinct()
    read = items.select(F.md5("item_text").alias("item_key"), F.explode(readings(F.col("item_text"), canonical)).alias("r"))
    words = read.select("item_key", "r.joined", F.col("r.canonical").alias("words")).filter(F.size("words") > 0)
    sized = words.withColumn("size", F.least(F.lit(WINDOW), F.size("words")))
    spots = sized.select("item_key", "joined", "words", "size", F.explode(windows(F.col("words"), F.col("size"))).alias("w")).select("item_key", "joined", "words", "size", "w.at", "w.hash")
    window = F.slice("words", F.col("at") + 1, F.col("size"))
    plain = F.filter(window, lambda w: ~w.rlike("^[\u0001-\u0003]"))
    # stretches between placeholders; a joint parts the runs of letters of one word
    stretches = F.transform(F.split(F.array_join(window, " "), "[\u0001-\u0003]"), lambda s: F.array_remove(F.split(s, LETTERS), ""))
    return spots.filter(F.size(plain) >= LITERALS).select("item_key", "joined", "size", "at", "hash", stretches.alias("plain"))


def run_hash(runs: Column, at: Column, size: Column) -> Column:
    """Digest of so many runs of letters side by side."""
    return F.coalesce(*(F.when(size == n, F.xxhash64(*(F.get(runs, at + k) for k in range(n)))) for n in range(1, ANCHOR + 1)))


def anchors_of(wanted: DataFrame) -> DataFrame:
    """(n, hash, word, place) of one anchor for each wanted window: n runs of letters, the longest of them and its place."""
    of_window = ["item_key", "joined", "size", "at"]
    stretch = wanted.select(*of_window, F.explode("plain").alias("s")).filter(F.size("s") > 0)
    places = stretch.withColumn("n", F.least(F.size("s"), F.lit(ANCHOR))).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("s") - F.col("n"))))
    spots = places.select(*of_window, "n", F.slice("s", F.col("i") + 1, F.col("n")).alias("words"))
    best = spots.groupBy(*of_window).agg(F.max(F.struct("n", F.length(F.array_join("words", "")).alias("letters"), "words")).alias("m"))
    longest = F.array_max(F.transform("m.words", lambda w, k: F.struct(F.length(w).alias("letters"), k.alias("place"), w.alias("word"))))
    picked = best.select("m.n", F.col("m.words").alias("words"), longest.alias("top")).distinct()
    return picked.select("n", run_hash(F.col("words"), F.lit(0), F.col("n")).alias("hash"), "top.word", "top.place").distinct()


def candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_key, text) of the distinct texts that hold an anchor."""
    anchors = stored(anchors_of(wanted))
    texts = docs.filter("text is not null").select(F.md5("text").alias("doc_key"), "text")
    # one row a text again, but a column of its own: else each place would cut the text anew
    runs = F.explode(F.array(F.struct(F.split(F.lower("text"), LETTERS).alias("w"))))
    read = texts.select("doc_key", runs.alias("r")).select("doc_key", F.col("r.w").alias("w"))
    if anchors.count() <= FEW_ANCHORS:
        # the longest word of an anchor is looked up at every place, its neighbours only where it stands
        spots = read.select("doc_key", "w", F.posexplode("w").alias("i", "word")).join(F.broadcast(anchors), "word")
        held = spots.filter(run_hash(F.col("w"), F.col("i") - F.col("place"), F.col("n")) == F.col("hash")).select("doc_key").distinct()
    else:
        # too many to send to every task: the digests of all places are shuffled to the anchors
        last = F.size("w")
        hashes = [
            F.transform(F.when(last >= n, F.sequence(F.lit(0), last - n)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(n))))  # noqa: B023
            for n in range(1, ANCHOR + 1)
        ]
        spots = read.select("doc_key", F.explode(F.concat(*hashes)).alias("hash"))
        held = spots.join(anchors.select("hash").distinct(), "hash", "left_semi").select("doc_key").distinct()
    # a number of its own, as the texts that are left are few but dear to read
    found = texts.join(held, "doc_key", "left_semi").repartition(shuffle_partitions(docs.sparkSession), "doc_key")
    return found.groupBy("doc_key").agg(F.first("text").alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, at, n_words, n_equal, n_changed) for each document and item that hold the same question.

    `at` is the word of the document where the item begins, `n_changed` counts slots with another value.
    """
    found = text_matches(docs, benchmark)
    holders = docs.filter("text is not null").select("doc_id", F.md5("text").alias("doc_key"))
    return holders.join(found, "doc_key").select("doc_id", "item_id", "at", "n_words", "n_equal", "n_changed").distinct()


def text_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_key, item_id, at, n_words, n_equal, n_changed) for each distinct text, told by its MD5, and item."""
    wanted = stored(item_windows(benchmark))
    texts = stored(candidates(docs, wanted))
    wanted = wanted.drop("plain")
    sizes = [r["size"] for r in wanted.select("size").distinct().orderBy("size").collect()]  # WINDOW rows at most
    cuts = [windows(F.col("r.canonical"), F.lit(n)) for n in sizes or [WINDOW]]
    read = texts.select("doc_key", F.explode(readings(F.col("text"), canonical)).alias("r"))
    spots = read.select("doc_key", "r.joined", F.explode(F.concat(*cuts)).alias("w"))
    hits = (
        spots.select("doc_key", "joined", F.col("w.at").alias("doc_at"), F.col("w.hash").alias("hash"))
        .join(wanted, ["hash", "joined"])
        .groupBy("doc_key", "joined", "item_key")
        .agg(F.collect_set(F.col("doc_at") - F.col("at")).alias("shifts"))
    )
    items = benchmark.filter("text is not null").select("item_id", F.md5("text").alias("item_key"), F.col("text").alias("item_text"))
    item_read = items.dropDuplicates(["item_key"]).select("item_key", F.size(canonical(F.col("item_text"))).alias("n_words"), F.explode(readings(F.col("item_text"), canonical, values)).alias("r"))
    item_words = item_read.select("item_key", "n_words", "r.joined", F.col("r.canonical").alias("iw"), F.col("r.values").alias("iv"))
    hit_docs = texts.join(hits.groupBy("doc_key").agg(F.collect_list(F.struct("joined", "item_key", "shifts")).alias("found")), "doc_key")
    one = hit_docs.select("doc_key", readings(F.col("text"), canonical, values).alias("r"), F.explode("found").alias("f"))
    reading = F.get("r", F.col("f.joined").cast("int"))
    shifted = (
        one.select("doc_key", reading["canonical"].alias("dw"), reading["values"].alias("dv"), "f.joined", "f.item_key", "f.shifts", F.explode("f.shifts").alias("shift"))
        .join(item_words, ["item_key", "joined"])
    )
    # Only the part of the document that the item may cover is kept, so that rows stay small.
    first = F.greatest(F.lit(0), F.col("shift") - DRIFT)
    span = F.size("iw") + 2 * DRIFT
    near = F.filter("shifts", lambda t: (t != F.col("shift")) & (F.abs(t - F.col("shift")) <= DRIFT))
    start = F.greatest(F.lit(0), F.col("shift"))
    parts = shifted.select(
        "doc_key",
        "item_key",
        "joined",
        "n_words",
        n_words(F.slice("dv", F.lit(1), start)).cast("int").alias("at"),
        "iw",
        "iv",
        F.transform(F.concat(F.array("shift"), F.array_sort(near)), lambda t: t - first).alias("moves"),
        F.slice("dw", first + 1, span).alias("dw"),
        F.slice("dv", first + 1, span).alias("dv"),
    )
    place = lambda i: i + F.get(F.filter("moves", lambda m: F.get("dw", i + m) == F.get("iw", i)), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0), F.size("iw") - 1), lambda i: F.struct(F.get("iw", i).alias("a"), F.get("iv", i).alias("x"), F.get("dv", place(i)).alias("y")))
    equal = parts.select("doc_key", "item_key", "joined", "n_words", "at", F.filter(pairs, lambda r: r["y"].isNotNull()).alias("equal"))
    slots = F.array_distinct(F.transform(F.filter("equal", lambda r: r["a"].rlike("^[\u0001-\u0003]")), lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"))))
    checked = equal.select("doc_key", "item_key", "joined", "at", "n_words", n_words(F.transform("equal", lambda r: r["x"])).cast("int").alias("n_equal"), slots.alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["x"])))
    changed = F.size(F.filter("slots", lambda s: s["x"] != s["y"]))
    enough = (F.col("n_equal") >= F.least(F.lit(RUN), F.col("n_words"))) & (F.col("n_equal") >= F.col("n_words") * SHARE)
    good = checked.filter(enough & consistent).withColumn("n_changed", changed)
    best = good.groupBy("doc_key", "item_key", "n_words").agg(F.max(F.struct(~F.col("joined"), "n_equal", -F.col("n_changed"), -F.col("at"))).alias("m"))
    return (
        best.select("doc_key", "item_key", (-F.col("m.col4")).alias("at"), "n_words", F.col("m.n_equal").alias("n_equal"), (-F.col("m.col3")).alias("n_changed"))
        .join(items.select("item_id", "item_key"), "item_key")
        .select("doc_key", "item_id", "at", "n_words", "n_equal", "n_changed")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark question, in all their columns; rows without an id or a text stay."""
    found = text_matches(docs, benchmark).select("doc_key").distinct()
    held = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("doc_key"))
    gone = stored(held.join(found, "doc_key", "left_semi").distinct().withColumnsRenamed({"doc_id": "gone_id", "doc_key": "gone_key"}))
    return docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.md5("text") == F.col("gone_key")), "left_anti")
