"""Candidate readings, catalog durations, language decisions, repeated hooks."""

from pyspark.sql import functions as F

from lexiline.operators import catalog, patterns, reports

RIP = "Dara Venn - Paper Lanterns - Moss Radio _ - SoundLoadMate.com.mp3"


def _cands(spark, artist, title, name):
    df = spark.createDataFrame([(1, artist, title, name, None)], "track_id long, artist string, title string, file_name string, duration_ms long")
    return [(r.artist, r.title) for r in catalog.metadata_candidates(df).orderBy("candidate_no").collect()]


def test_candidates(spark):
    got = _cands(spark, "Moss Radio ®", "Dara Venn - Paper Lanterns", RIP)
    assert got[0] == ("Moss Radio", "Dara Venn - Paper Lanterns") and ("Dara Venn", "Paper Lanterns") in got
    assert _cands(spark, None, None, RIP) == [("Dara Venn", "Paper Lanterns")]
    assert _cands(spark, "Tin Kettles", "Q.R.T.", "05 - Q.R.T..mp3")[0] == ("Tin Kettles", "Q.R.T.")
    assert _cands(spark, None, None, None) == []
    video = _cands(spark, None, None, "Ilo Brandt - Night's Turn (Official Music Video) [HD].mp3")
    assert video[0][0] == "Ilo Brandt" and "official" not in video[0][1].lower()


def test_catalog_prefers_a_close_duration(spark):
    cands = spark.createDataFrame([(1, 185_900, 0, "X", "Song")], "track_id long, duration_ms long, candidate_no long, artist string, title string")
    rows = [(i, "X", "Song", d, f"text {i}", f"[0:01.00] text {i}", i) for i, d in enumerate([150_000, None, 181_000, 186_000])]
    cat = spark.createDataFrame(rows, "entry_id long, artist string, title string, duration_ms long, plain string, synced string, rank long")
    hit = catalog.match_catalog(cands, cat).first()
    assert (hit.entry_id, hit.duration_mismatch) == (3, False)
    far = catalog.match_catalog(cands, cat.filter("entry_id < 2")).first()
    assert (far.entry_id, far.synced, far.duration_mismatch) == (0, None, True)


def test_language(spark):
    english = "these are plain words of a song"
    # The decision table.
    cases = [
        ("en", 0.95, {"en": 0.95}, None, "en", "detector"),
        ("km", 0.72, {"km": 0.72, "en": 0.11, "es": 0.03}, english, "en", "lyrics_script_override"),
        ("km", 0.72, {"km": 0.72, "ko": 0.1}, english, "en", "lyrics_script_override"),
        ("ko", 0.9, {"ko": 0.9, "en": 0.02}, "안녕하세요", "ko", "detector"),
        ("km", 0.31, {"km": 0.31, "es": 0.25, "en": 0.15}, None, "es", "low_confidence_fallback"),
        ("km", 0.2, None, None, "en", "low_confidence_fallback"),
        ("th", 0.7, {"th": 0.7, "es": 0.2}, "Camino pequeño, quizás vuelva otro día", "es", "lyrics_script_override"),
        (None, None, None, None, "en", "error_fallback"),
    ]
    rows = [(i, *c[:4]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id long, detected string, probability double, probs map<string,double>, ref_text string")
    got = [(r.language, r.language_source) for r in reports.choose_language(df).orderBy("id").collect()]
    assert got == [c[4:] for c in cases]


def test_hook_is_completed_where_it_breaks_off(spark, words):
    offsets = [0, 350, 600, 850, 1100]
    hook = "walk out of the trash".split()
    rows = [(w, at + o, at + o + 300, w == "trash") for at in (10_000, 20_000, 30_000) for w, o in zip(hook, offsets)]
    rows += [(w, 40_000 + o, 40_000 + o + 300) for w, o in zip(hook[:4], offsets)]
    out = patterns.infer_missing_completions(words(*rows)).collect()
    assert [(r.word, r.start_ms, r.detection_source) for r in out] == [("trash", 41_100, "hook_echo")]


def test_catalog_artists_meet_by_substrings(spark):
    entries = [
        (1, "Song", "The Ab", 100_000, 1, "one"), (2, "song", "Xab Quartet", 104_000, 2, "two"), (3, "Song", "Other", 200_000, 3, "three"),
        (4, "Song", "ab", None, 4, "four"), (5, "Song", None, 100_500, 5, "five"), (6, "Song", "Other", 199_000, 6, "six"),
    ]
    table = spark.createDataFrame(entries, "entry_id long, title string, artist string, duration_ms long, rank long, plain string").withColumn("synced", F.lit(None).cast("string"))
    cands = [(1, 0, "ab", 103_500), (2, 0, "Ab", None), (3, 1, "ab", 500_000), (4, 0, "Nobody", 199_500), (5, 1, "Nobody", 199_500), (6, 0, "Other feat. Ab", 205_000), (7, 0, "b", 100_000)]
    c = spark.createDataFrame([(t, n, a, "Song", d) for t, n, a, d in cands], "track_id long, candidate_no long, artist string, title string, duration_ms long")
    got = {r["track_id"]: (r["entry_id"], r["rung"], r["duration_mismatch"]) for r in catalog.match_catalog(c, table).collect()}
    # within five seconds by full artist; exact artist; nothing in time; title alone; no first reading; primary artist; one letter
    assert got == {1: (1, 1, False), 2: (4, 0, False), 3: (1, 1, True), 4: (3, 3, False), 6: (3, 2, False), 7: (1, 1, False)}
