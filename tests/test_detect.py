"""Golden tables of the detector: what must be caught, and what must never be."""

import pytest

from lexiline.operators import detect
from lexiline.sources import tables

MASKED = "f*** s*** n***a n**** f***ing f**king motherf***er f--- a** **** d**n b**** b*****s".split()
PLAIN = (
    "t-shirt x-ray e-mail co-op hip-hop so-called twenty-two check-in mother-in-law uh-huh na-na la-la one-two k-pop "
    "v-neck u-turn drive-in pick-up re-up a-ha well-known cha-cha f-150 he-ll ---- -- -"
).split()
STYLED = "biiitch pusssy fuuuck shiiit niggaaa fuuck shiit biitch biatchhh fucc fucck bytch shiet".split()
CLEAN = (
    "shot sheet shoot shoots beach batch fake folk cant can't shirt glass count ship class hash peach fact sheep duck sick "
    "sit chic clock rich which beech snitch ditch pitch witch assassin assess grass bass pass cocktail title shut chat good "
    "moon soon balloon coffee success cool look book feel see off egg ball small still happy butter dinner mirror yellow "
    "cookie raccoon cocoon god hellll"
).split()


@pytest.fixture(scope="module")
def hits(spark):
    tokens = spark.createDataFrame([(w,) for w in {*MASKED, *PLAIN, *STYLED, *CLEAN}], "word string")
    found = detect.scan_dictionary(tokens, tables.default_lexicon(spark)).collect()
    return {r.word: (r.matched, r.match_type) for r in found}


def test_masked_and_styled_forms_are_caught(hits):
    assert [w for w in MASKED + STYLED if w not in hits] == []


def test_ordinary_words_are_not(hits):
    assert [w for w in PLAIN + CLEAN if w in hits] == []


def test_tier_and_root(hits):
    assert hits["f***ing"] == ("fucking", "wildcard")
    assert hits["n***a"] == ("nigga", "wildcard")
    assert hits["fuuuck"][1] == "deelongate"


def _flags(df):
    return [r.is_profanity for r in df.orderBy("pos").collect()]


def test_compounds(spark, words):
    lex = tables.default_lexicon(spark, ["blowjob"])
    at = lambda *ws: words(*[(w, i * 500, i * 500 + 500) for i, w in enumerate(ws)])
    assert _flags(detect.flag_terms(at("oh", "god", "damn"), lex)) == [False, True, True]
    assert _flags(detect.flag_terms(at("blow", "job", "kick", "off"), lex)) == [True, True, False, False]
    assert _flags(detect.flag_terms(at("s", "hit"), lex)) == [False, False]


def test_gapped_compounds_need_the_language(spark, words):
    from pyspark.sql import functions as F

    lex = tables.lexicon_of(spark, [("nothing", "en", "exact")])
    w = words(("hijo", 0, 1), ("de", 1, 2), ("puta", 2, 3))
    assert _flags(detect.flag_terms(w.withColumn("language", F.lit("es")), lex)) == [True, True, True]
    assert _flags(detect.flag_terms(w.withColumn("language", F.lit("en")), lex)) == [False, False, False]


def test_vocab_flags_misheard_but_not_literal(spark, words):
    refs = spark.createDataFrame([(1, "the witches and b*tches were f***ing late")], "track_id long, text string")
    lex = tables.default_lexicon(spark)
    vocab = detect.extract_vocab(refs, lex, "track_id", "text")
    assert {r.term for r in vocab.collect()} == {"bitches", "fucking"}
    out = detect.flag_with_vocab(words(("witches", 0, 1), ("ducking", 2, 3), ("late", 4, 5)), vocab, refs)
    assert _flags(out) == [False, True, False]
