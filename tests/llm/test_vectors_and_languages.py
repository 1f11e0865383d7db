"""Hard negatives, language identification and whitening against brute force, and their odd cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiline.llm import cross_parse, feast_whitening, residue_mining

VECTORS = "vec_id long, embedding array<float>, label int, x string, score double, width int, n long"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "x", 1.0, 2, 3) for i, v, label in rows], VECTORS)


def as_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# hard negatives


@pytest.mark.parametrize("bound", [1, 300, 10**6, 10**9, 2**62])
@pytest.mark.parametrize("width", [1, 63, 64, 65, 200])
def test_residue_products_are_exact(bound, width):
    rng = np.random.default_rng(width)
    peak = max(1, int(math.isqrt(bound // width)))
    a, b = (rng.integers(-peak, peak + 1, size=(n, width)) for n in (7, 9))
    a[0], b[0] = peak, peak
    a[1] = -peak
    primes = residue_mining.primes_for(bound)
    got = residue_mining.products(residue_mining.residues(a, primes), residue_mining.residues(b, primes), primes)
    assert (got == (a.astype(object) @ b.astype(object).T)).all()


def test_few_primes_do_for_short_vectors():
    assert len(residue_mining.primes_for(70_000)) == 2
    assert all(p <= 1023 for p in residue_mining.small_primes())
    assert residue_mining.INNER * 511**2 < 1 << 24


def brute_negatives(rows, every, positives, negatives):
    live = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
        if sum(c * c for c in x) < 2**61:
            live[i, (label + 1) % 10 if i % 7 == 0 else label, x] = True
    out = []
    for i, label, x in live:
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j, other) for j, other, y in live if j != i and len(x) == len(y))
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(t, k) for t, k, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def odd_vectors(n, seed, large=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.4, -0.1, 0.2, 0.3, 0.9)) * large for _ in range(6)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, v, 1) for i, v in enumerate((None, [], [None] * 6, [NAN] + [0.1] * 5, [INF] + [0.1] * 5, [1e30] * 6, [0.0] * 6, [0.5] * 3, [0.4] * 3))]
    return [*rows, (None, [0.1] * 6, 1), (n + 50, [0.1] * 6, None), rows[3], rows[3], rows[0]]


@pytest.mark.parametrize("large", [1.0, 30_000.0])
def test_hard_negatives_equal_brute_force(spark, large):
    rows = odd_vectors(300, 3, large)
    got = residue_mining.hard_negatives(vectors_of(spark, rows).repartition(5), every=10)
    assert as_rows(got, *COLUMNS) == brute_negatives(rows, 10, 5, 3)


def test_small_blocks_give_the_same_negatives(spark, monkeypatch):
    rows = odd_vectors(200, 8)
    for name, value in (("ANCHORS", 7), ("ROWS", 40), ("SLICE", 3), ("BATCH", 16)):
        monkeypatch.setattr(residue_mining, name, value)
    got = residue_mining.hard_negatives(vectors_of(spark, rows), every=4, positives=2, negatives=4)
    assert as_rows(got, *COLUMNS) == brute_negatives(rows, 4, 2, 4)


def test_hard_negatives_of_little(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 0), (1, [1.0], 1)], [(None, None, None)]):
        out = residue_mining.hard_negatives(vectors_of(spark, rows))
        assert out.columns == list(COLUMNS)
        assert out.count() == 0


# language identification


def symbols_by_hand(text, alphabet):
    out = [cross_parse.GAP]
    for c in text.lower():
        s = alphabet.index(c) + 2 if c in alphabet else cross_parse.RARE if c.isalpha() else cross_parse.GAP
        if s != cross_parse.GAP or out[-1] != cross_parse.GAP:
            out.append(s)
    return out


def phrases_by_hand(symbols, training):
    """Longest matches found by looking through the training text."""
    hay, count = bytes(training), 0
    for at in range(0, len(symbols), cross_parse.PIECE):
        piece, i = bytes(symbols[at : at + cross_parse.PIECE]), 0
        while i < len(piece):
            n = 1
            while i + n < len(piece) and piece[i : i + n + 1] in hay:
                n += 1
            count, i = count + 1, i + n
    return count


def prose(words, n, rng):
    return " ".join(rng.choice(words) for _ in range(n))


LANGUAGES = {"aa": ["the", "and", "thing", "wer"], "bb": ["der", "die", "ßung", "üwe"], "cc": ["le", "été", "la", "ère"]}


def test_phrases_equal_a_search_through_the_training_text():
    rng = random.Random(4)
    passages = tuple((lang, tuple(prose(words, 40, rng) for _ in range(3))) for lang, words in LANGUAGES.items())
    parser = cross_parse.Parser(passages)
    alphabet = [chr(c) for c in sorted(np.flatnonzero(parser.table >= 2).tolist(), key=lambda c: parser.table[c])]
    texts = ["a", " ", "1 2", "Thé dér, 3 wer!!", "жж the жж", "the" * 2_000, *(prose(sum(LANGUAGES.values(), []), rng.randrange(1, 900), rng) for _ in range(8))]
    symbols, starts = parser.symbols_of(texts)
    laid = [s.tolist() for s in np.split(symbols, starts[1:])]
    assert laid == [symbols_by_hand(t, alphabet) for t in texts]
    got = parser.phrases(symbols, starts)
    for k, (_, found) in enumerate(passages):
        training = [s for p in found for s in [*symbols_by_hand(p, alphabet), parser.end]]
        assert got[:, k].tolist() == [phrases_by_hand(s, training) for s in laid]


DOCS = "doc_id long, text string, lang string, held_out boolean, score double"


def documents_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 0.5) for i, t, lang in rows], DOCS)


def language_rows(n=240):
    rng = random.Random(9)
    return [(i, prose(words, rng.randrange(3, 60), rng), lang) for i in range(n) for lang, words in [rng.choice(list(LANGUAGES.items()))]]


def test_languages_of_held_out_documents(spark):
    rows = language_rows()
    # one label in eight is wrong; learning leaves such passages out
    noisy = [(i, t, "aa" if i % 8 == 0 else lang) for i, t, lang in rows]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 .. 7", "bb"), (1003, "the thing " * 20_000, "aa"), (1004, "wer and", None), (None, "der die ßung", None), (3, rows[3][1], rows[3][2])]
    docs = documents_of(spark, noisy + odd)
    out = cross_parse.identify(docs, cross_parse.training_passages(docs)).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in truth:
            assert r["lang_pred"] == truth[r["doc_id"]]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert found[1000] == found[1001] == found[1002] == ("und", 0.0)
    assert found[1003][0] == found[1004][0] == "aa" and found[None][0] == "bb"


def test_languages_without_labels_and_layouts(spark):
    docs = documents_of(spark, [(i, "some text", None) for i in range(5)])
    assert {r["lang_pred"] for r in cross_parse.identify(docs, cross_parse.training_passages(docs)).collect()} == {"und"}
    none = documents_of(spark, [])
    assert cross_parse.identify(none, cross_parse.training_passages(none)).count() == 0
    rows = language_rows(120)
    one, two = (documents_of(spark, r).repartition(n) for r, n in ((rows, 1), (rows[::-1], 7)))
    assert cross_parse.training_passages(one) == cross_parse.training_passages(two)
    single = documents_of(spark, [(i, f"word {'abc'[i % 3]}", "aa") for i in range(30)])
    assert {(r["lang_pred"], r["score"]) for r in cross_parse.identify(single, cross_parse.training_passages(single)).collect()} == {("aa", 1.0)}


# whitening


@pytest.mark.parametrize("kind", ["plain", "repeated", "clustered", "low rank", "diagonal"])
def test_contour_integration_finds_all_eigenpairs(kind):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = {
        "plain": rng.uniform(0.1, 3, 40), "repeated": np.repeat([5.0, 2.0, 1.0, 0.5], 10), "clustered": 1 + 1e-7 * rng.normal(size=40),
        "low rank": np.r_[rng.uniform(1, 2, 5), np.zeros(35)], "diagonal": np.arange(40.0),
    }[kind]
    v = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    v = (v + v.T) / 2
    got, x = feast_whitening.eigenpairs(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    assert np.abs(got - want).max() < 1e-13 * max(want)
    assert np.abs(x.T @ x - np.eye(32)).max() < 1e-12
    assert np.abs(v @ x - x * got).max() < 1e-13 * max(want) * 40


def test_inertia_counts():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for cut in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
            assert feast_whitening.below(a, cut) == (values < cut).sum()
    assert feast_whitening.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=40) * np.linspace(0.3, 2, 40)).astype(np.float32).tolist(), 0) for i in range(300)]
    odd = [(900, None, 0), (901, [NAN] * 40, 0), (902, [INF] + [0.0] * 39, 0), (903, [None] * 40, 0), (904, [], 0), (905, [1e30] * 40, 0), (None, rows[0][1], 0), (5, rows[5][1], 0)]
    df = vectors_of(spark, rows + odd).repartition(6)
    got = feast_whitening.whiten(df, feast_whitening.fit(df)).collect()
    kept = [*rows, odd[-2], odd[-1]]
    x = np.floor(64 * np.array([v for _, v, _ in kept], dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    assert len(got) == 32 * n
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    white = (x - sums / n) @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    by_id = {i: k for k, (i, _, _) in enumerate(kept)}
    signs = {}
    for r in got:
        k, c = by_id[r["vec_id"]], r["component"] - 1
        sign = signs.setdefault(c, np.sign(r["whitened"] * white[k, c]))
        assert abs(r["whitened"] - sign * white[k, c]) < 1e-9
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))
        assert abs(r["explained"] / (values[::-1][c] / values.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-9


def test_whitening_of_little_and_of_other_lengths(spark):
    none = vectors_of(spark, [])
    assert feast_whitening.whiten(none, feast_whitening.fit(none)).count() == 0
    rows = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, [1.0, 2.0, 0.0], 0), (4, [2.0, 1.0, 0.0], 0), (5, [1e11, 0.0, 0.0, 1.0], 0), (6, [-1e11, 0.0, 0.0, 2.0], 0)]
    df = vectors_of(spark, rows)
    out = feast_whitening.whiten(df, feast_whitening.fit(df)).collect()
    found = {(r["vec_id"], r["component"]): r for r in out}
    assert len(out) == 2 * 2 + 2 * 3 + 2 * 4
    assert found[1, 1]["whitened"] is None and found[1, 1]["explained"] is None and found[1, 1]["identity_error"] is None and found[1, 1]["deviation"] == 0
    assert abs(abs(found[3, 1]["whitened"]) - 1) < 1e-12 and found[3, 2]["whitened"] is None and found[3, 1]["explained"] == pytest.approx(1)
    assert found[3, 1]["identity_error"] < 1e-12 and found[3, 1]["n"] == 2
    assert found[5, 1]["deviation"] is None and abs(abs(found[5, 1]["whitened"]) - 1) < 1e-12


def test_exact_sums_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(12)
    df = vectors_of(spark, [(i, (rng.normal(size=5) * 1e6).tolist(), 0) for i in range(200)])
    fits = [feast_whitening.fit(d) for d in (df.repartition(1), df.repartition(9), df.orderBy(F.rand(1)))]
    for f in fits[1:]:
        assert f[5].sums == fits[0][5].sums and (f[5].vectors == fits[0][5].vectors).all()
