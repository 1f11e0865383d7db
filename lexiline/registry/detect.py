"""D: term detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiline import fixed
from lexiline.operators import detect
from lexiline.registry import fixtures as fx
from lexiline.registry.base import query
from lexiline.registry.text import _CS, _ONE, _THREE_ONE, _THREE_TWO, _forms_sql

ROOTS = tuple(fx.TERMS)
ALLOW = ("the", "moron")


def allowed_sql(x: str, allow=ALLOW) -> str:
    return f"list_has_any({_forms_sql(f'lower({x})', True)}, {list(allow)!r})"


EXACT_SQL = f"list_has_any({_forms_sql('lower(word)', True)}, {list(fx.TERMS)!r})"


@query(
    "d1_match_exact",
    f"WITH {fx.MIX}, v AS (SELECT DISTINCT word FROM mix), h AS (SELECT word FROM v WHERE {EXACT_SQL} AND NOT {allowed_sql('word')}) SELECT track_id, pos, word FROM mix JOIN h USING (word)",
)
def d1(spark, sf):
    words = fx.mix_words(spark, sf)
    hits = detect.match_exact(detect.dictionary(words), fx.lexicon(spark), ALLOW)
    return words.join(hits, "word").select("track_id", "pos", "word")


def wildcard_sql(x: str, roots=ROOTS, allow=ALLOW) -> str:
    w = fx.WCLASS
    raw = rf"lower(regexp_replace({x}, '[^{w}*\-]', '', 'g'))"
    letters = rf"regexp_replace({raw}, '[*\-]', '', 'g')"
    cases = " ".join(
        "WHEN regexp_full_match(" + raw + ", '" + "".join(f"[{ch}*\\-]" for ch in r) + f"') THEN '{r}'" for r in roots
    )
    ok = rf"length({raw}) >= 3 AND regexp_matches({raw}, '[*\-]') AND ({letters} <> '' OR regexp_full_match({raw}, '\*{{3,}}')) AND {letters} NOT IN {fx.in_list(allow)}"
    return f"CASE WHEN {ok} THEN CASE {cases} END END"


@query(
    "d2_match_wildcard",
    f"WITH {fx.STYLED}, v AS (SELECT DISTINCT word FROM styled WHERE regexp_matches(word, '[*\\-]')) SELECT word, {wildcard_sql('word')} AS matched FROM v WHERE {wildcard_sql('word')} IS NOT NULL",
)
def d2(spark, sf):
    dic = detect.dictionary(fx.styled_words(spark, sf))
    return detect.match_wildcard(dic, ROOTS, ALLOW).select("word", "matched")


DEEL_SQL = f"""deel AS (SELECT word, CASE WHEN list_contains({list(fx.TERMS)!r}, f1) AND f1 <> s AND f1 NOT IN {fx.in_list(ALLOW)} THEN f1
  WHEN list_contains({list(fx.TERMS)!r}, f2) AND f2 <> s AND f2 NOT IN {fx.in_list(ALLOW)} THEN f2
  WHEN list_contains({list(fx.TERMS)!r}, f3) AND f3 <> s AND f3 NOT IN {fx.in_list(ALLOW)} THEN f3 END AS matched
  FROM (SELECT word, s, {_ONE} AS f1, {_THREE_ONE} AS f2, {_THREE_TWO} AS f3 FROM (SELECT word, s, {_CS} AS cs FROM
    (SELECT word, {fx.sq('word')} AS s FROM v) WHERE length(s) >= 4 AND s NOT IN {fx.in_list(ALLOW)})))"""


@query(
    "d3_match_deelongated",
    f"WITH {fx.STYLED}, v AS (SELECT DISTINCT word FROM styled), {DEEL_SQL} SELECT * FROM deel WHERE matched IS NOT NULL",
)
def d3(spark, sf):
    dic = detect.dictionary(fx.styled_words(spark, sf))
    return detect.match_deelongated(dic, fx.lexicon(spark), ALLOW).select("word", "matched")


FUZZY_SQL = f"""fuzzy AS (SELECT word, arg_max(root, (s, -i)) AS matched FROM (
  SELECT word, root, i, {fx.lev_sql('k', 'root')} * 100 AS s FROM (SELECT word, {fx.lev_key_sql('word')} AS k FROM v
    WHERE length({fx.sq('word')}) >= 4 AND {fx.sq('word')} NOT IN {fx.in_list(ALLOW)}),
  (SELECT unnest({list(ROOTS)!r}) AS root, unnest(range({len(ROOTS)})) AS i)) WHERE s >= 80 GROUP BY word)"""


@query("d4_match_fuzzy_levenshtein", f"WITH {fx.MISHEARD}, v AS (SELECT DISTINCT word FROM misheard), {FUZZY_SQL} SELECT * FROM fuzzy")
def d4_lev(spark, sf):
    dic = detect.dictionary(fx.misheard_words(spark, sf))
    return detect.match_fuzzy(dic, ROOTS, ALLOW, "levenshtein", 80.0).select("word", "matched")


@query("d4_match_fuzzy")
def d4(spark, sf):
    dic = detect.dictionary(fx.misheard_words(spark, sf))
    return detect.match_fuzzy(dic, ROOTS, ALLOW, floor=80.0).select("word", "matched")


TIER_SQL = f"""t AS (SELECT word, CASE WHEN NOT a THEN CASE WHEN e THEN 'exact' WHEN w IS NOT NULL THEN 'wildcard' WHEN d IS NOT NULL THEN 'deelongate' WHEN f IS NOT NULL THEN 'fuzzy' END END AS match_type,
  CASE WHEN NOT a THEN CASE WHEN e THEN word ELSE coalesce(w, d, f) END END AS matched
  FROM (SELECT v.word, {allowed_sql('v.word')} AS a, {EXACT_SQL.replace('word', 'v.word')} AS e, {wildcard_sql('v.word')} AS w, deel.matched AS d, fuzzy.matched AS f
  FROM v LEFT JOIN deel ON deel.word = v.word LEFT JOIN fuzzy ON fuzzy.word = v.word))"""


@query(
    "d5_scan_tokens",
    f"WITH {fx.STYLED}, v AS (SELECT DISTINCT word FROM styled), {DEEL_SQL}, {FUZZY_SQL.replace('>= 80', '>= 85')}, {TIER_SQL} SELECT track_id, pos, matched, match_type FROM styled JOIN t USING (word)",
)
def d5(spark, sf):
    """All four tiers over every token; the fuzzy tier under the edit-distance metric."""
    scanned = detect.scan_tokens(
        fx.styled_words(spark, sf), fx.lexicon(spark), allowlist=ALLOW, wildcard_roots=ROOTS, style_roots=ROOTS,
        fuzzy_metric="levenshtein", fuzzy_floor=85.0,
    )
    return scanned.select("track_id", "pos", "matched", "match_type")


@query(
    "x2_looser_fuzzy_floor",
    f"WITH {fx.MISHEARD}, v AS (SELECT DISTINCT word FROM misheard), {DEEL_SQL}, {FUZZY_SQL.replace('>= 80', '>= 88')}, {TIER_SQL} SELECT track_id, pos, matched, match_type FROM misheard JOIN t USING (word)",
)
def x2(spark, sf):
    """The tiers with the floor of 88 of the second channel, over words with wrong last letters."""
    scanned = detect.scan_tokens(
        fx.misheard_words(spark, sf), fx.lexicon(spark), allowlist=ALLOW, wildcard_roots=ROOTS, style_roots=ROOTS,
        fuzzy_metric="levenshtein", fuzzy_floor=88.0,
    )
    return scanned.select("track_id", "pos", "matched", "match_type")


COMPOUND = f"""c AS (SELECT *, lag(s, 2) OVER o AS p2, lag(s) OVER o AS p1, lead(s) OVER o AS n1, lead(s, 2) OVER o AS n2
  FROM (SELECT track_id, pos, language, word, {fx.sq('word')} AS s FROM mix) WINDOW o AS (PARTITION BY track_id ORDER BY pos))"""


def pair_sql(a: str, b: str) -> str:
    en = fx.in_list("+".join(p) for p in fx.PAIRS)
    es = fx.in_list("+".join(p) for p in fx.PAIRS_ES)
    return f"coalesce({a} || '+' || {b} IN {en} OR (language = 'es' AND {a} || '+' || {b} IN {es}), false)"


ADJ = f"({pair_sql('s', 'n1')} OR {pair_sql('p1', 's')})"


def gap_sql(a: str, m: str, b: str) -> str:
    return f"(coalesce({m} IN {fx.in_list(fx.GAPS)}, false) AND {pair_sql(a, b)})"


GAP = f"({gap_sql('s', 'n1', 'n2')} OR {gap_sql('p1', 's', 'n1')} OR {gap_sql('p2', 'p1', 's')})"


def join_sql(a: str, b: str) -> str:
    return f"coalesce(length({a}) >= 3 AND length({b}) >= 3 AND {a} || {b} IN {fx.in_list((*fx.TERMS, *JOIN_TERMS))}, false)"


JOIN_TERMS = ("thethe", "andthe", "attionthe")
JOINED = f"({join_sql('s', 'n1')} OR {join_sql('p1', 's')})"


def _compounds(spark, sf, kind):
    lex = fx.lexicon(spark, JOIN_TERMS)
    out = detect.compound_flags(fx.mix_words(spark, sf), lex, fx.PAIRS, fx.PAIRS_ES, fx.GAPS, (), kinds=(kind,))
    return out.filter(kind).select("track_id", "pos", "word")


@query("d6_adjacent_compounds", f"WITH {fx.MIX}, {COMPOUND} SELECT track_id, pos, word FROM c WHERE {ADJ}")
def d6(spark, sf):
    return _compounds(spark, sf, "adjacent")


@query("d7_joined_compounds", f"WITH {fx.MIX}, {COMPOUND} SELECT track_id, pos, word FROM c WHERE {JOINED}")
def d7(spark, sf):
    return _compounds(spark, sf, "joined")


@query("d8_gapped_compounds", f"WITH {fx.MIX}, {COMPOUND} SELECT track_id, pos, word FROM c WHERE {GAP}")
def d8(spark, sf):
    return _compounds(spark, sf, "gapped")


LISTED = [*fx.TERMS, *JOIN_TERMS]
FLAG_SQL = f"""WITH {fx.STYLED}, v AS (SELECT DISTINCT word FROM styled), {DEEL_SQL.replace(fx.in_list(ALLOW), "('moron')").replace(repr(list(fx.TERMS)), repr(LISTED))},
t AS (SELECT v.word, NOT {allowed_sql('v.word', ('moron',))} AND ({EXACT_SQL.replace('word', 'v.word').replace(repr(list(fx.TERMS)), repr(LISTED))} OR {wildcard_sql('v.word', allow=('moron',))} IS NOT NULL OR deel.matched IS NOT NULL) AS own
  FROM v LEFT JOIN deel ON deel.word = v.word), {COMPOUND.replace('FROM mix)', 'FROM styled)')}
SELECT track_id, pos, own OR {ADJ} OR {JOINED} OR {GAP} AS is_profanity FROM c JOIN t USING (word)"""


@query("d9_flag_terms", FLAG_SQL)
def d9(spark, sf):
    """Flags rebuilt from scratch: exact, masked and elongated terms, then the three compound kinds."""
    lex = fx.lexicon(spark, JOIN_TERMS)
    out = detect.flag_terms(
        fx.styled_words(spark, sf), lex, pairs=fx.PAIRS, pairs_es=fx.PAIRS_ES, gap_words=fx.GAPS, allowlist=("moron",),
        wildcard_roots=ROOTS, tiers=("exact", "wildcard", "deelongate"),
    )
    return out.select("track_id", "pos", "is_profanity")


@query("d9_flag_terms_all_tiers")
def d9_all(spark, sf):
    """Every tier with the built-in roots and lists next to the sample terms."""
    out = detect.flag_terms(fx.styled_words(spark, sf), fx.lexicon(spark), style_roots=(*fixed.STYLE_ROOTS, *ROOTS))
    return out.filter("is_profanity").select("track_id", "pos", "word", "matched", "match_type")


CUSTOM = ("thereing", "lette", "stupid")


def loose_sql(w: str, t: str) -> str:
    longer = f"CASE WHEN length({w}) > {len(t)} THEN {w} ELSE '{t}' END"
    shorter = f"CASE WHEN length({w}) <= {len(t)} THEN {w} ELSE '{t}' END"
    common = f"len(list_filter(string_split({shorter}, ''), lambda ch: ch <> '' AND contains({longer}, ch)))"
    return (
        f"(starts_with({w}, '{t}') OR starts_with('{t}', {w}) OR (length({w}) >= 4 AND abs(length({w}) - {len(t)}) <= 2 "
        f"AND {common}::DOUBLE / length({longer}) >= 0.8))"
    )


LOOSE = "(n <> '' AND (" + " OR ".join(loose_sql("n", t) for t in CUSTOM) + "))"
CUSTOM_SQL = f"""WITH {fx.FLAGGED}, v AS (SELECT DISTINCT word, lower(regexp_replace(word, '[^A-Za-z0-9_'']', '', 'g')) AS n FROM flagged),
h AS (SELECT word, {LOOSE} AS c, n <> '' AND {loose_sql('n', 'lette')} AS gone FROM v)"""


@query(
    "d10_apply_custom_terms",
    CUSTOM_SQL + " SELECT track_id, pos, is_profanity OR c AS is_profanity, CASE WHEN c AND NOT is_profanity THEN 'custom' END AS detection_source FROM flagged JOIN h USING (word)",
)
def d10(spark, sf):
    out = detect.apply_custom_terms(fx.flagged_words(spark, sf), CUSTOM)
    return out.select("track_id", "pos", "is_profanity", "detection_source")


@query(
    "d10_remove_custom_terms",
    CUSTOM_SQL + """, a AS (SELECT track_id, pos, is_profanity OR c AS f, CASE WHEN c AND NOT is_profanity THEN 'custom' END AS src, gone FROM flagged JOIN h USING (word))
SELECT track_id, pos, f AND NOT (gone AND coalesce(src = 'custom', false)) AS is_profanity, CASE WHEN NOT (gone AND coalesce(src = 'custom', false)) THEN src END AS detection_source FROM a""",
)
def d10r(spark, sf):
    added = detect.apply_custom_terms(fx.flagged_words(spark, sf), CUSTOM)
    return detect.remove_custom_terms(added, "lette").select("track_id", "pos", "is_profanity", "detection_source")


@query(
    "d11_highlight_terms",
    f"WITH {fx.MIX} SELECT track_id, pos, regexp_replace(lower(trim(word)), '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g') IN {fx.in_list((*fx.TERMS, 'ho'))} AS highlighted FROM mix",
)
def d11(spark, sf):
    out = detect.highlight_terms(fx.mix_words(spark, sf), (*fx.TERMS, "ho"))
    return out.select("track_id", "pos", "highlighted")


def _mark_refs(spark, sf):
    """Texts in which every listed term followed by a blank is masked where the document id is even."""
    docs = fx.table(spark, sf, "documents")
    body = F.col("text")
    for t in fx.TERMS:
        masked = t[0] + "*" * (len(t) - 2) + t[-1]
        body = F.when(F.col("doc_id") % 2 == 0, F.replace(body, F.lit(t + " "), F.lit(masked + " "))).otherwise(body)
    return docs.select("doc_id", body.alias("text"))


def mark_sql() -> str:
    body = "text"
    for t in fx.TERMS:
        body = f"replace({body}, '{t} ', '{t[0] + '*' * (len(t) - 2) + t[-1]} ')"
    return f"marked AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {body} ELSE text END AS text FROM documents)"


VOCAB_SQL = f"""{mark_sql()}, vt AS (SELECT DISTINCT doc_id AS track_id, unnest(regexp_extract_all(text, '[{fx.WCLASS}''*-]+')) AS word FROM marked),
vd AS (SELECT DISTINCT word FROM vt), vh AS (SELECT word, CASE WHEN {EXACT_SQL} THEN lower(word) ELSE {wildcard_sql('word', allow=('clown',))} END AS term FROM vd
  WHERE NOT {allowed_sql('word', ('clown',))}), vocab AS (SELECT DISTINCT track_id, term FROM vt JOIN vh USING (word) WHERE term IS NOT NULL)"""


@query("d12_extract_vocab", f"WITH {VOCAB_SQL} SELECT track_id, term FROM vocab")
def d12(spark, sf):
    return detect.extract_vocab(
        _mark_refs(spark, sf), fx.lexicon(spark), "doc_id", "text", ("clown",), wildcard_roots=ROOTS, tiers=("exact", "wildcard")
    )


VOCAB_FLAG_SQL = f"""WITH {fx.MISHEARD}, {VOCAB_SQL}, lit AS (SELECT DISTINCT doc_id AS track_id, unnest(regexp_extract_all(lower(text), '[{fx.WCLASS}'']+')) AS l FROM marked),
own AS (SELECT DISTINCT track_id, word FROM misheard WHERE NOT is_profanity), ok AS (SELECT * FROM own o WHERE NOT {allowed_sql('word', ('clown',))}
  AND NOT EXISTS (SELECT 1 FROM lit WHERE lit.track_id = o.track_id AND l = lower(regexp_replace(o.word, '[^{fx.WCLASS}'']', '', 'g')))),
sc AS (SELECT ok.track_id, word, {fx.lev_sql(fx.lev_key_sql('word'), fx.lev_key_sql('term'))} AS s, CASE WHEN length(term) <= 3 THEN 0.95 WHEN length(term) = 4 THEN 0.90 ELSE 0.75 END AS need
  FROM ok JOIN vocab USING (track_id)),
hit AS (SELECT DISTINCT track_id, word FROM sc WHERE s >= need)
SELECT m.track_id, m.pos, m.is_profanity OR hit.word IS NOT NULL AS is_profanity, CASE WHEN hit.word IS NOT NULL AND NOT m.is_profanity THEN 'lyrics' END AS detection_source
FROM misheard m LEFT JOIN hit ON hit.track_id = m.track_id AND hit.word = m.word"""


def _vocab_flags(spark, sf, metric):
    refs = _mark_refs(spark, sf)
    vocab = detect.extract_vocab(refs, fx.lexicon(spark), "doc_id", "text", ("clown",), wildcard_roots=ROOTS, tiers=("exact", "wildcard"))
    words = fx.misheard_words(spark, sf)
    out = detect.flag_with_vocab(words, vocab, refs.withColumnRenamed("doc_id", "track_id"), metric=metric, allowlist=("clown",))
    return out.select("track_id", "pos", "is_profanity", "detection_source")


@query("d13_flag_with_vocab_levenshtein", VOCAB_FLAG_SQL)
def d13_lev(spark, sf):
    return _vocab_flags(spark, sf, "levenshtein")


@query("d13_flag_with_vocab")
def d13(spark, sf):
    return _vocab_flags(spark, sf, "ratcliff").filter("is_profanity")


@query(
    "d14_mask_text",
    f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[ \\n\\t]+|[^ \\n\\t]+') AS ps FROM documents), v AS (SELECT DISTINCT unnest(ps) AS word FROM p),
h AS (SELECT list(word) AS hs FROM v WHERE {EXACT_SQL})
SELECT doc_id, array_to_string(list_transform(ps, lambda x: CASE WHEN list_contains(hs, x) THEN repeat('*', length(x)) ELSE x END), '') AS masked,
  len(list_distinct(list_filter(ps, lambda x: list_contains(hs, x))))::INTEGER AS n_masked_terms FROM p, h""",
)
def d14(spark, sf):
    out = detect.mask_text(fx.table(spark, sf, "documents"), "doc_id", "text", fx.lexicon(spark), allowlist=(), tiers=("exact",))
    return out.select("doc_id", "masked", "n_masked_terms")
