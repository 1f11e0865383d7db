"""Reference text as tokens for alignment."""

import random
import re

from lexiline.operators import align
from lexiline.sources import tables

PAGE = """3 Contributors Some Title
[Verse 1: A (B)]
Don't   fuckin' go, ¡niñó! (ooh
yeah) ok) 24 hours -
You might also like

[Chorus]
rock''n word(hey) привет end12Embed
"""


def _tokens(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    return tables.normalize_reference(docs, "id", "body")


def test_tokens_of_a_scraped_page(spark):
    rows = sorted(_tokens(spark, PAGE).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert [r.norm for r in rows] == ["don't", "fuckin", "go", "nino", "ooh", "yeah", "ok", "<star>", "hours", "<star>", "<star>", "wordhey", "<star>", "end"]
    assert all(PAGE[r.char_start : r.char_end] == r.raw for r in rows)
    assert [r.raw for r in rows if r.is_adlib] == ["(ooh", "yeah)", "word(hey)"]
    assert {r.line_no for r in rows} == {2, 3, 7}


def test_brackets_never_closed_null_empty_and_long_texts(spark):
    long = "(a) b\n" * 20_000
    rows = _tokens(spark, None, "", " \n\t", "a) b (c d\ne", "[Only]", "5Embed", long).collect()
    by = {k: sorted((r.pos, r.norm, r.is_adlib) for r in rows if r.track_id == k) for k in {r.track_id for r in rows}}
    assert set(by) == {3, 6}
    assert [x[1:] for x in by[3]] == [("a", False), ("b", False), ("c", True), ("d", True), ("e", True)]
    assert len(by[6]) == 40_000 and all(adlib == (norm == "a") for _, norm, adlib in by[6])


def test_alignment_skips_stars(spark, words):
    spoken = words(*[(w, 400 * i, 400 * i + 300) for i, w in enumerate("never gonna give you up never gonna let you down".split())])
    tokens = _tokens(spark, "x", "[Hook]\nNever gonna 1987 give you up - (never gonna) 7 let you dówn")
    ref = tables.alignable(tokens.filter("track_id = 1"))
    places = {r.pos: (r.ref_pos, r.token) for r in ref.collect()}
    found = align.align(spoken, ref.select("track_id", "pos", "token")).collect()
    assert sorted((r.ref_pos, r.word_pos) for r in found) == [(i, i) for i in range(10)]
    assert places[2] == (3, "give") and places[9][1] == "down" and tables.STAR not in {t for _, t in places.values()}


def test_texts_with_unlike_ids_are_cut_where_they_stand(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab()\n ", weights=(4, 4, 2, 2, 1, 4), k=rng.randint(0, 60))) for _ in range(80)]
    tokens = _tokens(spark, *texts)
    assert "Window" not in tokens._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for k, body in enumerate(texts):
        depth, pos = 0, 0
        for m in re.finditer(r"[^ \n]+", body):
            want.append((k, pos, m.group(), m.start(), m.end(), depth > 0 or "(" in m.group()))
            depth = max(0, depth + m.group().count("(") - m.group().count(")"))
            pos += 1
    assert sorted((r.track_id, r.pos, r.raw, r.char_start, r.char_end, r.is_adlib) for r in tokens.collect()) == want


def test_texts_that_share_an_id_are_numbered_together(spark):
    docs = spark.createDataFrame([(1, "a (b"), (1, "a (b"), (2, "c) d"), (None, "e")], "id long, body string")
    got = sorted((r.track_id, r.pos, r.raw, r.is_adlib) for r in tables.normalize_reference(docs, "id", "body").collect())
    assert got == [(1, 0, "a", False), (1, 1, "a", False), (1, 2, "(b", True), (1, 3, "(b", True), (2, 0, "c)", False), (2, 1, "d", False)]
