"""Tests of spellings run once a spelling, not once a token."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexiline.functions import similarity, text
from lexiline.operators import blocks, detect, evidence, intervals, patterns
from lexiline.sources import tables


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def _line(plan, text) -> int:
    return next(i for i, l in enumerate(plan) if text in l)


def test_spellings_are_tested_above_their_grouping(spark):
    words = spark.createDataFrame([("abcd",), ("abcd",), ("x",), (None,)], "word string").repartition(2)
    hits = detect.custom_hits(words, ["abc"])
    plan = _plan(hits)
    assert _line(plan, "StartsWith") < _line(plan, "Aggregate")
    assert [r.word for r in hits.collect()] == ["abcd"]
    assert sorted(r.word for r in detect.dictionary(words).collect()) == ["abcd", "x"]


def test_loose_match_counts_characters_that_the_longer_spelling_holds(spark):
    def slow(word: str, term: str) -> bool:
        w = "".join(c for c in word if c.isascii() and (c.isalnum() or c in "_'")).lower()
        longer, shorter = (w, term) if len(w) > len(term) else (term, w)
        common = sum(c in longer for c in shorter)
        near = len(w) >= 4 and len(term) >= 4 and abs(len(w) - len(term)) <= 2 and common / len(longer) >= 0.8
        return w != "" and (w.startswith(term) or term.startswith(w) or near)

    rng = random.Random(5)
    words = sorted({"".join(rng.choices("letao'-É", k=rng.randint(1, 8))) for _ in range(400)})
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", detect.loose_match("word", "lette").alias("m"))
    assert {r.word: r.m for r in rows.collect()} == {w: slow(w, "lette") for w in words}


def test_words_without_patterns_do_not_move(spark, monkeypatch):
    moved = []
    plain = blocks.neighbours
    monkeypatch.setattr(blocks, "neighbours", lambda df, *a, **k: moved.append(df) or plain(df, *a, **k))
    hook = "walk out of the trash".split()
    rows = [(t, 10 * i + k, w, 4_000 * i + 400 * k, 4_000 * i + 400 * k + 300, w == "trash") for t in (1, 2) for i in range(3) for k, w in enumerate(hook + ["x"] * 5) if t == 1 or w != "of"]
    words = spark.createDataFrame(rows, "track_id long, pos long, word string, start_ms long, end_ms long, is_profanity boolean").withColumn("language", F.lit("en"))
    words = words.filter("track_id = 1").unionByName(words.filter("track_id = 2").withColumn("is_profanity", F.lit(False)))
    mined = patterns.mine_prefix_patterns(words)
    for few in (True, False):
        monkeypatch.setattr(patterns, "FEW_PATTERNS", patterns.FEW_PATTERNS if few else 0)
        sites = patterns.find_prefix_sites(words, mined)
        assert sorted((r.track_id, r.run_from, r.run_to, r.m) for r in sites.collect()) == [(1, 10 * i, 10 * i + 3, 4) for i in range(3)]
        assert {r.track_id for r in moved[-1].collect()} == ({1} if few else {1, 2})
    assert mined.first().display == "trash" and all("language" not in df.columns for df in moved)
    assert {(r.word, r.end_ms) for r in moved[0].filter("not is_profanity").collect()} == {(None, None)}


def test_pairs_are_scored_where_they_are_like_one_by_one(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéßñIi'漢-!") for _ in range(rng.choice([1, 3, 6, 9])))
    odd = [("a!\r\n", "a!"), ("b'\r", "b"), (None, "a"), ("a", None), ("", ""), ("!", "!"), ("ab" * 60, "ab" * 59 + "c"), ("Élan", "elan")]
    words = [word() for _ in range(60)]
    rows = odd + [(rng.choice(words), rng.choice(words)) for _ in range(3000)]
    rows += [(w, w[:-1] + rng.choice("xé'")) for w in words]
    df = spark.createDataFrame(rows, "a string, b string")
    for floor in (0.0, 0.5, 0.6):
        scored = similarity.score_pairs(df, "a", "b", "ratcliff", floor)
        assert not any(x in "\n".join(_plan(scored)) for x in ("Join", "Aggregate", "Repartition"))
        forms = scored.select("a", "b", "sim", text.lower_forms("a").alias("x"), text.lower_forms("b").alias("y")).collect()
        for r in forms:
            same = r.a is not None and r.b is not None and r.a.lower() == r.b.lower()
            assert r.sim == (1.0 if same else similarity.forms_similarity(r.x, r.y, floor)), r


def _timed(spark):
    words = spark.createDataFrame(
        [(t, k, w, 4_000 * k, 4_000 * k + 300, 0.4, w == "trash", None) for t, said in ((1, "hello wurld of trash again".split()), (2, ["hello"])) for k, w in enumerate(said)],
        "track_id long, word_id long, word string, start_ms long, end_ms long, confidence double, is_profanity boolean, detection_source string",
    )
    lines = [(t, n, 4_000 * n, text) for t in (1, 2) for n, text in enumerate(("hello world", "world world", "one two three", "stupid trash trash"))]
    return words, spark.createDataFrame(lines, "track_id long, line_no long, time_ms long, text string")


def test_lines_are_sorted_out_before_their_words_move(spark):
    words, lines = _timed(spark)
    lexicon = tables.lexicon_of(spark, [("trash", "en", "exact"), ("stupid", "en", "exact")])
    gaps = evidence.gap_words_timed(words, lines, None, "levenshtein")
    terms = evidence.injected_timed_terms(words, lines, lexicon, "levenshtein", allowlist=(), tiers=("exact",))
    for plan in (_plan(gaps), _plan(terms)):
        assert _line(plan, "Generate posexplode") < _line(plan, "__first")
    # Track 2 would get more than twice as many words as it has.
    assert sorted((r.track_id, r.line_no, r.word) for r in gaps.collect()) == [(1, 2, "one"), (1, 2, "three"), (1, 2, "two"), (1, 3, "stupid"), (1, 3, "trash"), (1, 3, "trash")]
    assert sorted((r.track_id, r.line_no, r.word_no) for r in terms.collect()) == [(1, 3, 1), (1, 3, 2)]


def test_matches_move_without_the_words_and_only_flagged_ones_again(spark):
    words, lines = _timed(spark)
    lexicon = tables.lexicon_of(spark, [("world", "en", "exact")])
    ref = evidence.estimate_line_words(lines)
    exchanges = [l for l in evidence.best_match_in_window(words, ref, "levenshtein")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in l]
    assert "w_word" not in exchanges[0] and "__wn" in exchanges[0]
    out = evidence.correct_words(words, ref, lexicon, "levenshtein", allowlist=(), tiers=("exact",))
    assert sum("ref_word" in l and "Join LeftOuter" in l for l in _plan(out)) == 0
    got = {(r.track_id, r.word_id): (r.word, r.original_word, r.matched_ref) for r in out.collect()}
    assert got[1, 1] == ("world", "wurld", True) and got[2, 0] == ("hello", None, True) and len(got) == 6


def test_instances_are_found_once_and_slots_look_at_tracks_with_sites(spark, monkeypatch):
    seen = []
    plain = intervals.slot_occupants
    monkeypatch.setattr(intervals, "slot_occupants", lambda s, w, *a: seen.append(w) or plain(s, w, *a))
    said = "walk out of the trash".split() + ["x"] * 5
    rows = [(t, 10 * i + k, f"{w}{'' if t == 1 else i}", 4_000 * i + 400 * k, 4_000 * i + 400 * k + 300, w == "trash") for t in (1, 2) for i in range(3) for k, w in enumerate(said)]
    words = spark.createDataFrame(rows, "track_id long, pos long, word string, start_ms long, end_ms long, is_profanity boolean")
    mined = patterns.mine_prefix_patterns(words)
    assert not any("Window" in l for l in _plan(mined))
    for few in (True, False):
        monkeypatch.setattr(patterns, "FEW_PATTERNS", 1_000_000 if few else 0)
        out = patterns.classify_sites(words, mined, "levenshtein")
        assert [(r.track_id, r.run_from, r.state) for r in out.orderBy("run_from").collect()] == [(1, 10 * i, "completed") for i in range(3)]
        assert {r.track_id for r in seen[-1].collect()} == ({1} if few else {1, 2})


def test_a_quantile_moves_the_bins_around_its_rank_only(spark, monkeypatch):
    moved = []
    plain = blocks.possible
    monkeypatch.setattr(blocks, "possible", lambda *a: moved.append(plain(*a)) or moved[-1])
    rng = random.Random(9)
    rows = [(k, rng.choice([round(rng.uniform(-1, 1), 3), 0.5])) for k in ("a", "b", None) for _ in range(500)] + [("c", None), ("d", 0.25)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {}
    for few in (True, False):
        monkeypatch.setattr(blocks, "FEW_BINS", 1_000_000 if few else 0)
        got[few] = {r.k: r["quantile"] for r in blocks.exact_quantile(df, ["k"], "v", 0.95, 0.01).collect()}
    assert got[True] == got[False] and set(got[True]) == {"a", "b", "d"}
    assert got[True]["d"] == 0.25
    assert moved[0].count() < 100 and moved[1].count() == 1501


def test_words_that_are_not_listed_do_not_move_to_the_list(spark, monkeypatch):
    words, lines = _timed(spark)
    lexicon = tables.lexicon_of(spark, [("trash", "en", "exact"), ("stupid", "en", "exact")])
    moved = []
    plain = blocks.possible
    monkeypatch.setattr(blocks, "possible", lambda *a: moved.append(plain(*a)) or moved[-1])
    for few in (True, False):
        monkeypatch.setattr(evidence, "FEW_HITS", 1_000_000 if few else 0)
        terms = evidence.injected_timed_terms(words, lines, lexicon, "levenshtein", allowlist=(), tiers=("exact",))
        assert sorted((r.track_id, r.line_no, r.word_no) for r in terms.collect()) == [(1, 3, 1), (1, 3, 2)]
        assert {r.raw for r in moved[-1].collect()} == ({"trash", "stupid"} if few else {"hello", "world", "one", "two", "three", "trash", "stupid"})
