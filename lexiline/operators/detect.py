"""Term detection: dictionary tiers, compounds, custom terms, vocabularies and masking.

Tokens are looked up through the distinct token dictionary: each spelling is classified once and
the (few) hits are joined back. No side is broadcast by hint; Spark broadcasts the hit table or the
lexicon when its measured size allows and splits skewed tokens otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexiline import fixed, session
from lexiline.functions import similarity, text
from lexiline.operators import blocks

HITS = "word STRING, matched STRING, match_type STRING"


def dictionary(tokens: DataFrame, col: str = "word") -> DataFrame:
    """Distinct tokens. The spelling is made to depend on its count: a test of a plain grouping key would be moved below the grouping
    and run once a token instead of once a spelling."""
    counted = tokens.select(F.col(col).alias("__w")).filter(F.col("__w").isNotNull()).groupBy("__w").agg(F.count("*").alias("__n"))
    return counted.select(F.when(F.col("__n") > 0, F.col("__w")).alias("word"))


def is_allowed(c, allowlist: Sequence[str] = fixed.ALLOWLIST) -> Column:
    """Whether any spelling of the token is on the allow-list."""
    if not allowlist:
        return F.lit(False)
    listed = F.array(*[F.lit(t.lower()) for t in allowlist])
    return F.arrays_overlap(text.lower_forms(c), listed)


def exact_terms(lexicon: DataFrame) -> DataFrame:
    return lexicon.filter(F.col("tier").isin("exact", "style")).select(F.lower("term").alias("term")).distinct()


def match_exact(dic: DataFrame, lexicon: DataFrame, allowlist: Sequence[str] = fixed.ALLOWLIST) -> DataFrame:
    """Dictionary tokens with a spelling in the exact list and none on the allow-list."""
    return scan_dictionary(dic, lexicon, allowlist, tiers=("exact",))


def _root_pattern(root: str) -> str:
    return "^" + "".join(f"[{re.escape(ch)}*-]" for ch in root) + "$"


def wildcard_root(
    c, roots: Sequence[str] = fixed.WILDCARD_ROOTS, allowlist: Sequence[str] = fixed.ALLOWLIST
) -> Column:
    """The first root a masked spelling stands for, or null: * and - are one character each.

    One fixed pattern per root, evaluated only for tokens that carry a mask character.
    """
    raw = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, rf"[^{text.W}*\-]", ""))
    letters = F.regexp_replace(raw, r"[*\-]", "")
    masked = (F.length(raw) >= fixed.WILDCARD_MIN_LEN) & raw.rlike(r"[*\-]")
    masked = masked & ((letters != "") | raw.rlike(r"^\*{3,}$"))
    if allowlist:
        masked = masked & ~letters.isin(*allowlist)
    first = F.coalesce(*[F.when(raw.rlike(_root_pattern(r)), r) for r in roots])
    return F.when(masked, first)


def match_wildcard(dic: DataFrame, roots: Sequence[str] = fixed.WILDCARD_ROOTS, allowlist: Sequence[str] = fixed.ALLOWLIST) -> DataFrame:
    """Masked tokens and the root they stand for; no other table is involved."""
    hit = dic.filter(F.col("word").rlike(r"[*\-]")).withColumn("matched", wildcard_root("word", roots, allowlist))
    return hit.filter(F.col("matched").isNotNull()).withColumn("match_type", F.lit("wildcard"))


def match_deelongated(dic: DataFrame, lexicon: DataFrame, allowlist: Sequence[str] = fixed.ALLOWLIST) -> DataFrame:
    """Tokens of at least four word characters whose collapsed spelling is in the exact list."""
    return scan_dictionary(dic, lexicon, allowlist, tiers=("deelongate",), check_forms=False)


def fuzzy_root(
    norm,
    roots: Sequence[str] = fixed.STYLE_ROOTS,
    metric: str = "indel",
    floor: float = fixed.FUZZY_MIN,
) -> Column:
    """Best root at or above the floor, or null; the first listed root wins ties.

    An indel distance is never below the edit distance, so the bounded built-in Levenshtein test
    rejects nearly every root before the exact ratio is computed.
    """
    norm = F.col(norm) if isinstance(norm, str) else norm
    listed = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(r).alias("root")) for i, r in enumerate(roots)])
    total = lambda r: F.length(norm) + F.length(r["root"])
    if metric == "levenshtein":
        ratio = lambda r: similarity.lev_similarity(norm, r["root"]) * 100
        near = listed
    else:
        ratio = lambda r: similarity.common_subsequence_expr(norm, r["root"]) * 200.0 / total(r)
        slack = F.lit(1 - floor / 100.0)
        near = F.filter(
            listed,
            lambda r: (F.abs(F.length(norm) - F.length(r["root"])) <= slack * total(r) + 1e-9)
            & (F.levenshtein(norm, r["root"]) <= slack * total(r) + 1e-9),
        )
    scored = F.transform(near, lambda r: F.struct(ratio(r).alias("s"), r["i"].alias("i"), r["root"].alias("root")))
    best = F.array_max(F.filter(scored, lambda r: r["s"] >= floor))
    return best["root"]


def match_fuzzy(
    dic: DataFrame,
    roots: Sequence[str] = fixed.STYLE_ROOTS,
    allowlist: Sequence[str] = fixed.ALLOWLIST,
    metric: str = "indel",
    floor: float = fixed.FUZZY_MIN,
) -> DataFrame:
    """Tokens of at least four word characters that come close enough to a root."""
    norm = text.squash("word")
    hit = dic.filter(F.length(norm) >= fixed.STYLE_MIN_LEN)
    if allowlist:
        hit = hit.filter(~norm.isin(*allowlist))
    spelling = similarity.lev_key("word") if metric == "levenshtein" else norm
    hit = hit.withColumn("matched", fuzzy_root(spelling, roots, metric, floor))
    return hit.filter(F.col("matched").isNotNull()).withColumn("match_type", F.lit("fuzzy"))


TIERS = ("exact", "wildcard", "deelongate", "fuzzy")


def scan_dictionary(
    dic: DataFrame,
    lexicon: DataFrame,
    allowlist: Sequence[str] = fixed.ALLOWLIST,
    wildcard_roots: Sequence[str] = fixed.WILDCARD_ROOTS,
    style_roots: Sequence[str] = fixed.STYLE_ROOTS,
    tiers: Sequence[str] = TIERS,
    fuzzy_metric: str = "indel",
    fuzzy_floor: float = fixed.FUZZY_MIN,
    check_forms: bool = True,
) -> DataFrame:
    """Hits (word, matched, match_type) of a distinct token table; the first tier that matches wins.

    One pass over the dictionary: every tier adds its candidates to one array, exploded once. The
    exact and de-elongated candidates carry a spelling to look up, the others are already decided.
    """

    def cand(rank, order, term, matched):
        return F.struct(
            F.lit(rank).alias("rank"),
            order.cast("int").alias("ord"),
            term.cast("string").alias("term"),
            matched.cast("string").alias("matched"),
        )

    none = F.lit(None)
    empty = F.array().cast("array<struct<rank: int, ord: int, term: string, matched: string>>")
    word, norm = F.col("word"), F.col("__norm")
    base = dic.select("word", text.squash("word").alias("__norm"), text.lower_forms("word").alias("__forms"))
    if allowlist and check_forms:
        listed = F.array(*[F.lit(t.lower()) for t in allowlist])
        base = base.filter(~F.arrays_overlap("__forms", listed))
    approx = F.length(norm) >= fixed.STYLE_MIN_LEN
    if allowlist:
        approx = approx & ~norm.isin(*allowlist)

    parts = []
    if "exact" in tiers:
        parts.append(F.transform("__forms", lambda f: cand(0, F.lit(0), f, word)))
    if "wildcard" in tiers:
        root = F.when(word.rlike(r"[*\-]"), wildcard_root("word", wildcard_roots, allowlist))
        parts.append(F.when(root.isNotNull(), F.array(cand(1, F.lit(0), none, root))).otherwise(empty))
    if "deelongate" in tiers:
        forms = text.deelongate(norm)
        if allowlist:
            forms = F.filter(forms, lambda f: ~f.isin(*allowlist))
        collapsed = F.transform(forms, lambda f, i: cand(2, i, f, f))
        parts.append(F.when(approx & norm.rlike(r"(.)\1"), collapsed).otherwise(empty))
    if "fuzzy" in tiers:
        spelling = similarity.lev_key("word") if fuzzy_metric == "levenshtein" else norm
        root = F.when(approx, fuzzy_root(spelling, style_roots, fuzzy_metric, fuzzy_floor))
        parts.append(F.transform(F.filter(F.array(root), lambda r: r.isNotNull()), lambda r: cand(3, F.lit(0), none, r)))
    rows = base.select("word", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("c")).select("word", "c.*")
    terms = exact_terms(lexicon).select("term", F.lit(True).alias("__known"))
    hit = rows.join(terms, "term", "left").filter(F.col("__known") | F.col("term").isNull())
    best = hit.groupBy("word").agg(F.min_by(F.struct("rank", "matched"), F.struct("rank", "ord")).alias("h"))
    name = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("h.rank") + 1)
    return best.select("word", "h.matched", name.alias("match_type"))


def scan_tokens(tokens: DataFrame, lexicon: DataFrame, col: str = "word", **kw) -> DataFrame:
    """Add `matched` and `match_type` to every token; null where no tier matches."""
    hits = scan_dictionary(dictionary(tokens, col), lexicon, **kw).withColumnRenamed("word", "__w")
    base = tokens.drop("matched", "match_type")
    return base.join(hits, F.col(col) == F.col("__w"), "left").drop("__w")


def compound_flags(
    words: DataFrame,
    lexicon: DataFrame | None,
    pairs: Sequence[tuple[str, str]] = fixed.COMPOUNDS,
    pairs_es: Sequence[tuple[str, str]] = fixed.COMPOUNDS_ES,
    gap_words: Sequence[str] = fixed.GAP_WORDS,
    allowlist: Sequence[str] = fixed.ALLOWLIST,
    keys: Sequence[str] = ("track_id",),
    kinds: Sequence[str] = ("adjacent", "joined", "gapped"),
) -> DataFrame:
    """Add a boolean per kind telling whether the word is part of such a compound.

    `words.pos` must be dense per key. A `language` column, where present, switches the Spanish
    pairs on. Each word looks two positions both ways, so one chunked pass serves all kinds.
    """
    w = text.squash("word")
    near = blocks.neighbours(
        words, list(keys), {"__p2": (w, -2), "__p1": (w, -1), "__n1": (w, 1), "__n2": (w, 2)}
    ).withColumn("__w", w)
    spanish = F.coalesce(F.col("language") == "es", F.lit(False)) if "language" in words.columns else F.lit(False)

    def listed(a, b) -> Column:
        joined = F.concat(F.col(a), F.lit("+"), F.col(b))
        hit = joined.isin(*["+".join(p) for p in pairs]) if pairs else F.lit(False)
        if pairs_es:
            hit = hit | (spanish & joined.isin(*["+".join(p) for p in pairs_es]))
        return F.coalesce(hit, F.lit(False))

    def gapped(a, mid, b) -> Column:
        return F.coalesce(F.col(mid).isin(*gap_words), F.lit(False)) & listed(a, b)

    if "adjacent" in kinds:
        near = near.withColumn("adjacent", listed("__w", "__n1") | listed("__p1", "__w"))
    if "gapped" in kinds:
        near = near.withColumn(
            "gapped", gapped("__w", "__n1", "__n2") | gapped("__p1", "__w", "__n1") | gapped("__p2", "__p1", "__w")
        )
    if "joined" in kinds:
        long_enough = lambda a, b: (F.length(a) >= fixed.JOINED_MIN_LEN) & (F.length(b) >= fixed.JOINED_MIN_LEN)
        terms = exact_terms(lexicon)
        if allowlist:
            terms = terms.filter(~F.col("term").isin(*allowlist))
        for name, a, b in (("__jn", "__w", "__n1"), ("__jp", "__p1", "__w")):
            side = terms.select(F.col("term").alias(f"{name}_t"), F.lit(True).alias(name))
            cond = (F.concat(F.col(a), F.col(b)) == F.col(f"{name}_t")) & long_enough(a, b)
            near = near.join(side, cond, "left").drop(f"{name}_t")
        near = near.withColumn("joined", F.coalesce("__jn", F.lit(False)) | F.coalesce("__jp", F.lit(False)))
        near = near.drop("__jn", "__jp")
    return near.drop("__p2", "__p1", "__n1", "__n2", "__w")


def flag_terms(
    words: DataFrame,
    lexicon: DataFrame,
    keys: Sequence[str] = ("track_id",),
    pairs: Sequence[tuple[str, str]] = fixed.COMPOUNDS,
    pairs_es: Sequence[tuple[str, str]] = fixed.COMPOUNDS_ES,
    gap_words: Sequence[str] = fixed.GAP_WORDS,
    allowlist: Sequence[str] = fixed.ALLOWLIST,
    **scan_kw,
) -> DataFrame:
    """Rebuild `is_profanity` from scratch: token tiers, then the three compound kinds."""
    scanned = scan_tokens(words, lexicon, allowlist=allowlist, **scan_kw)
    near = compound_flags(scanned, lexicon, pairs, pairs_es, gap_words, allowlist, keys)
    flag = F.col("match_type").isNotNull() | F.col("adjacent") | F.col("joined") | F.col("gapped")
    return near.withColumn("is_profanity", flag).drop("adjacent", "joined", "gapped")


def _loose_key(word) -> Column:
    return F.lower(F.regexp_replace(F.col(word) if isinstance(word, str) else word, r"[^A-Za-z0-9_']", ""))


def loose_match(word, term: str) -> Column:
    """Prefix either way, or at least 80 % of the shorter spelling's characters occur in the longer."""
    return _loosely(_loose_key(word), term)


def _loosely(w: Column, term: str) -> Column:
    """`loose_match` of a `_loose_key`."""
    t = re.sub(r"[^a-z0-9_']", "", term.lower())
    if not t:
        return F.lit(False)
    lit = F.lit(t)
    prefix = w.startswith(lit) | lit.startswith(w)
    longer = F.when(F.length(w) > len(t), w).otherwise(lit)
    shorter = F.when(F.length(w) <= len(t), w).otherwise(lit)
    common = F.size(F.filter(F.split(shorter, ""), lambda ch: (ch != "") & longer.contains(ch)))
    overlap = (
        (F.length(w) >= 4)
        & F.lit(len(t) >= 4)
        & (F.abs(F.length(w) - len(t)) <= 2)
        & (common / F.length(longer) >= 0.8)
    )
    return (w != "") & (prefix | overlap)


def custom_hits(words: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Distinct tokens that loosely match any custom term."""
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | _loosely(F.col("__key"), t)
    # An exploded key is computed once a spelling; an alias would be put in place of each of its uses.
    keyed = dictionary(words).select("word", F.explode(F.array(_loose_key("word"))).alias("__key"))
    return keyed.filter(any_term).select("word")


def apply_custom_terms(words: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Flag unflagged words that match a custom term; source `custom`."""
    hits = custom_hits(words, terms).select("word", F.lit(True).alias("__c"))
    joined = words.join(hits, "word", "left")
    new = F.coalesce("__c", F.lit(False)) & ~F.coalesce("is_profanity", F.lit(False))
    return (
        joined.withColumn("detection_source", F.when(new, "custom").otherwise(F.col("detection_source")))
        .withColumn("is_profanity", F.coalesce("is_profanity", F.lit(False)) | F.coalesce("__c", F.lit(False)))
        .select(*words.columns)
    )


def remove_custom_terms(words: DataFrame, term: str) -> DataFrame:
    """Un-flag words whose flag came from a custom term that matches the removed one."""
    hits = custom_hits(words, [term]).select("word", F.lit(True).alias("__c"))
    joined = words.join(hits, "word", "left")
    gone = F.coalesce("__c", F.lit(False)) & F.coalesce(F.col("detection_source") == "custom", F.lit(False))
    return (
        joined.withColumn("is_profanity", F.when(gone, F.lit(False)).otherwise(F.col("is_profanity")))
        .withColumn("detection_source", F.when(~gone, F.col("detection_source")))
        .select(*words.columns)
    )


def highlight_terms(tokens: DataFrame, terms: Sequence[str] = fixed.HIGHLIGHT_TERMS, col: str = "word") -> DataFrame:
    """Add `highlighted`: the token without its edges is in the short list."""
    cleaned = F.regexp_replace(F.lower(F.trim(col)), r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")
    return tokens.withColumn("highlighted", cleaned.isin(*terms))


def extract_vocab(refs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, allowlist: Sequence[str] = fixed.ALLOWLIST, **scan_kw) -> DataFrame:
    """Distinct flagged vocabulary per text (track_id, term); masked spellings become their root."""
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(rf"([{text.W}'*-]+)"), F.lit(1))
    rows = refs.select(F.col(id_col).alias("track_id"), F.explode(F.array_distinct(tokens)).alias("word")).distinct()
    hits = scan_dictionary(dictionary(rows), lexicon, allowlist=allowlist, **scan_kw)
    roots = scan_kw.get("wildcard_roots", fixed.WILDCARD_ROOTS)
    lowered = F.lower("word")
    term = (
        F.when(F.col("match_type") == "wildcard", F.lower("matched"))
        .when(lowered.rlike(r"[*\-]"), F.coalesce(F.lower(wildcard_root(lowered, roots, allowlist)), lowered))
        .otherwise(lowered)
    )
    return rows.join(hits, "word").select("track_id", term.alias("term")).distinct()


def vocab_threshold(term, base: float = 0.75) -> Column:
    n = F.length(term)
    return F.when(n <= 3, 0.95).when(n == 4, 0.90).otherwise(base)


def flag_with_vocab(
    words: DataFrame,
    vocab: DataFrame,
    ref_text: DataFrame | None = None,
    base: float = 0.75,
    metric: str = "ratcliff",
    allowlist: Sequence[str] = fixed.ALLOWLIST,
) -> DataFrame:
    """Flag unflagged words that resemble their track's vocabulary; source `lyrics`.

    Words on the allow-list and words the reference text itself contains are left alone. `ref_text`
    has (track_id, text). Words meet the terms of their own track whose lengths permit the threshold, by
    an equi join on both; the similarity of a pair that meets in several tracks is computed once.
    """
    own = words.filter(~F.coalesce("is_profanity", F.lit(False))).select("track_id", "word").distinct()
    if ref_text is not None:
        literal = F.regexp_extract_all(F.lower("text"), F.lit(rf"([{text.W}']+)"), F.lit(1))
        present = ref_text.select("track_id", F.explode(F.array_distinct(literal)).alias("__lit")).distinct()
        own = own.withColumn("__lit", F.lower(F.regexp_replace("word", f"[^{text.W}']", "")))
        own = own.join(present, ["track_id", "__lit"], "left_anti").drop("__lit")

    terms = vocab.select("track_id", "term").distinct().withColumn("__need", vocab_threshold("term", base))
    own = own.join(terms.select("track_id").distinct(), "track_id", "left_semi").filter(~is_allowed("word", allowlist))
    if metric == "levenshtein":
        # The compared spellings' lengths give the reach of a term.
        own = own.withColumn("__kw", similarity.lev_key("word")).withColumn("__len", F.length("__kw"))
        terms = terms.withColumn("__kt", similarity.lev_key("term"))
        n = F.length("__kt")
        reach = F.sequence(F.ceil(n * F.col("__need") - 1e-9).cast("int"), F.floor(n / F.col("__need") + 1e-9).cast("int"))
        met = own.join(terms.withColumn("__len", F.explode(reach)), ["track_id", "__len"])
        hit = met.filter(similarity.lev_similarity("__kw", "__kt") >= F.col("__need"))
    else:
        # Any spelling of the word may be the similar one, so the reach is tested per spelling.
        own = own.withColumn("__len", F.explode(F.array_distinct(F.transform(text.lower_forms("word"), F.length))))
        lengths = F.transform(text.lower_forms("term"), F.length)
        r = F.col("__need")
        lo = F.floor(F.array_min(lengths) * r / (2 - r)).cast("int")
        hi = F.ceil(F.array_max(lengths) * (2 - r) / r).cast("int")
        met = own.join(terms.withColumn("__len", F.explode(F.sequence(lo, hi))), ["track_id", "__len"])
        met = session.cut_lineage(met.select("track_id", "word", "term", "__need").distinct())
        pairs = met.select("word", "term", "__need").distinct()
        score = similarity.similarity_udf(min(base, 0.75))(text.lower_forms("word"), text.lower_forms("term"))
        hit = met.join(pairs.filter(score >= F.col("__need")).select("word", "term"), ["word", "term"], "left_semi")
    hit = hit.select("track_id", "word").distinct()
    marked = words.join(hit.withColumn("__v", F.lit(True)), ["track_id", "word"], "left")
    new = F.coalesce("__v", F.lit(False)) & ~F.coalesce("is_profanity", F.lit(False))
    return (
        marked.withColumn("detection_source", F.when(new, "lyrics").otherwise(F.col("detection_source")))
        .withColumn("is_profanity", F.coalesce("is_profanity", F.lit(False)) | new)
        .select(*words.columns)
    )


def mask_text(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, **scan_kw) -> DataFrame:
    """Whole texts with each flagged token replaced by asterisks of the same length.

    The text is rebuilt where it lives: its own hits travel to it as a small distinct list, the text
    is never exploded and regrouped.
    """
    tokens = F.array_distinct(F.filter(F.split(F.col(text_col), r"[ \n\t]+"), lambda t: t != ""))
    pairs = docs.select(F.col(id_col), F.explode(tokens).alias("word"))
    hits = scan_dictionary(dictionary(pairs), lexicon, **scan_kw).select("word")
    own = pairs.join(hits, "word", "left_semi").groupBy(id_col).agg(F.collect_set("word").alias("__hits"))
    joined = docs.join(own, id_col, "left")
    # Split keeps separators: each piece is a run of blanks or a token.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"([ \n\t]+|[^ \n\t]+)"), F.lit(1))
    masked = F.array_join(
        F.transform(
            pieces, lambda p: F.when(F.array_contains("__hits", p), F.repeat(F.lit("*"), F.length(p))).otherwise(p)
        ),
        "",
    )
    out = F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(masked)
    return joined.withColumn("masked", out).withColumn("n_masked_terms", F.coalesce(F.size("__hits"), F.lit(0))).drop("__hits")
