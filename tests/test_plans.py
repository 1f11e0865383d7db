"""What steps that every word passes through may carry: plans and files, with their results."""

import random
import re

from pyspark.sql import functions as F

from lexiline.functions import similarity, text
from lexiline.operators import evidence, intervals
from lexiline.registry.patterns import h12
from lexiline.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_json_words_are_compressed_and_split(spark, words, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 2)
    src = words(*[(f"w{i}", i * 400, i * 400 + 300) for i in range(5)]).coalesce(1)
    tables.write_words(src, str(tmp_path / "w"), "json")
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) == 3 and all(f.name.endswith(".json.gz") for f in files)
    cols = ["track_id", "pos", "word", "start_ms", "end_ms", "confidence", "is_profanity"]
    back = tables.read_words(spark, str(tmp_path / "w")).select(*cols)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, src.select(*cols).collect()))


def test_templates_carry_only_what_they_read(spark, tmp_path):
    docs = [(1, "a b a b a b a b a", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = h12(spark, str(tmp_path))
    assert not re.search(r"Exchange.*\n.*(lang|language|end_ms)#", plan(out)) and "lang#" not in plan(out)
    # Confidence rises with the place: of three parts of the five a, and of two of the four b, the last of each.
    got = sorted(map(tuple, out.collect()))
    assert [(g, p) for _, g, p, _ in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_line_is_not_carried_by_its_words(spark):
    lines = spark.createDataFrame([(1, 0, 1000, "one two  three"), (1, 1, 2200, "four"), (2, 0, 0, None)], "track_id long, line_no long, time_ms long, text string")
    out = evidence.estimate_line_words(lines)
    above = plan(out).split("Generate posexplode(")[0]
    assert "split(" not in above
    kept = re.search(r"Generate posexplode\([^\[]*\), \[([^\]]*)\]", plan(out)).group(1)
    assert "text#" not in kept and "__tokens#" not in kept
    got = sorted(map(tuple, out.select("line_no", "word", "start_ms", "end_ms", "dur_ms", "line_words").collect()))
    assert got == [(0, "one", 1000, 1350, 1200, 3), (0, "three", 1800, 2150, 1200, 3), (0, "two", 1400, 1750, 1200, 3), (1, "four", 2200, 2550, 5000, 1)]


def test_copies_of_a_time_join_carry_no_borders(spark):
    l = spark.createDataFrame([(1, 7, 0, 12_000), (1, 8, 30_000, 20_000)], "track_id long, a long, s long, e long")
    r = spark.createDataFrame([(1, 70, 11_000, 40_000), (1, 71, 12_001, 12_500)], "track_id long, b long, rs long, re long")
    out = intervals.overlap_pairs(l, r, ("s", "e"), (F.col("rs"), F.col("re")))
    assert "__llo" not in plan(out) and "__rlo" not in plan(out)
    assert [tuple(x) for x in out.collect()] == [(1, 7, 0, 12_000, 70, 11_000, 40_000)]


def test_letters_rule_out_only_unlike_words(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aaeéèEÉbcstxßñ'-1") for _ in range(rng.randint(1, 9)))
    rows = []
    for _ in range(1500):
        a = word()
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice("aeéxyz'")
        rows.append((a, "".join(b) if rng.random() < 0.7 else word()))
    rows += [("", "ab"), ("bdfhj", "aceg"), ("Élan", "elan")]
    low = lambda c: F.lower(c)
    sets = lambda c: (f"{c}s", f"{c}f")
    df = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        df = df.withColumn(f"{c}s", similarity.letters(low(c))).withColumn(f"{c}f", similarity.letters(text.strip_accents(low(c))))
    for floor in (0.5, 0.6):
        fits = df.select("a", "b", similarity.ratio_possible("a", "b", sets("a"), sets("b"), floor).alias("fits"), similarity.similarity_udf(floor)(text.lower_forms("a"), text.lower_forms("b")).alias("s"))
        got = fits.collect()
        assert all(x.fits for x in got if x.s >= floor)
        assert sum(not x.fits for x in got) > 50


def test_unlike_words_never_become_pairs_to_score(spark, monkeypatch):
    seen = []
    real = similarity.score_pairs
    monkeypatch.setattr(similarity, "score_pairs", lambda df, *a, **k: (seen.append(df), real(df, *a, **k))[1])
    words = spark.createDataFrame([(1, 0, "hello", 0), (1, 1, "qqqqq", 400)], "track_id long, word_id long, word string, start_ms long")
    ref = spark.createDataFrame([(1, 0, 0, "helo", 100), (1, 0, 1, "zebra", 200)], "track_id long, line_no long, word_no long, word string, start_ms long")
    best = evidence.best_match_in_window(words, ref).collect()
    assert [(x.word_id, x.ref_word) for x in best] == [(0, "helo")]
    assert [(x.w_word, x.r_word) for x in seen[0].collect()] == [("hello", "helo")]
