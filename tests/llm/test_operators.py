"""The training-data operators against brute force, and their odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiline.llm import chosen_path, chunk_bpe, jump_shard, lattice, license_scan, orc_tokens, pieces, revisits, template_decontam, toxicity_fm, window_lm
from lexiline.llm.common import components

DOCS = "doc_id long, text string, lang string, node string, key long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(900)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*t, "en", "x", 1) if isinstance(t, tuple) else (i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "a", "\n \t", "x" * 20_000, "é" * 9_000, prose(9_000, 1), prose(40, 2), prose(40, 2), "a  b <|endoftext|> c.\n\nD 's"]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# sharding


def jump_reference(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_function(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(0, 5000, 37)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 300):
        assert [r[0] for r in df.select(jump_shard.jump(F.col("k"), n)).collect()] == [jump_reference(k, n) for k in keys]


def test_layout_is_gapless_and_keeps_repeated_rows(spark):
    docs = docs_of(spark, [*ODD, (3, "same", 0)[:2], (3, "same"), (None, "n"), (None, "n")])
    out = jump_shard.layout(docs, 24).collect()
    assert len(out) == docs.count()
    for shard in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in out)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] not in (3, None)}
    for r in out:
        if r["doc_id"] in texts:
            body = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 8, zlib.crc32(body), "key")
    assert jump_shard.layout(docs.limit(0)).count() == 0


def test_slots_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame([(i % 70 * 1024, "same" if i % 3 else str(i)) for i in range(400)], "doc_id long, text string")
    assert sorted(jump_shard.layout(docs).collect()) == sorted(jump_shard.layout(docs.repartition(7, "text")).collect())
    few = jump_shard.layout(docs, blocks=4).collect()
    for shard in {r["shard"] for r in few}:
        assert sorted(r["slot"] for r in few if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in few)))


# tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_and_chunks_encode_like_the_library(name):
    rng = random.Random(9)
    alphabet = " \n\t.,;:!?'sabéß1 2日x<>|≠́ \x85 \x1c "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += [t or "" for t in ODD] + [prose(700, 4), "日本語" * 2000, "foo.bar x!? \nBar\n\nBaz \n q." * 80]
    path = pieces.vocabulary(name)
    tokenizer, enc = pieces.load(path), pieces.Encoder(path)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [enc.unpack(i).tolist() for i in enc.encode(texts)] == want
    for text, ids in zip(texts, want, strict=True):
        data = text.encode()
        ends = chunk_bpe.ends_of(data)
        chunks = [data[a:z].decode() for a, z in zip([0, *ends], ends)]
        assert "".join(chunks) == text
        parts = [pieces.cut(c) for c in chunks]
        memo = enc.learn(parts)
        done = [chunk_bpe.marks_of(p, memo) for p in parts]
        if len(chunks) > 1:
            joins = chunk_bpe.repaired(chunks, done)
            windows = enc.raw([w for j in joins for w in j[2:]])
            assert enc.unpack(chunk_bpe.joined(chunks, done, joins, windows[::2], windows[1::2], enc.raw)).tolist() == ids


def test_chunked_digests_equal_whole_texts(spark):
    shared = prose(400, 11)
    texts = [*ODD, *(prose(60, s) + " " + shared + prose(80, s + 50) for s in range(12)), shared, (None, shared), (4, "a")]
    docs = docs_of(spark, texts)
    path = pieces.vocabulary("word_bpe_49k.json")
    tokenizer = pieces.load(path)
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = rows(chunk_bpe.digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)
    encoded = chunk_bpe.encode(docs, path)
    assert rows(chunk_bpe.decode(encoded, path), "doc_id", "text") == rows(
        spark.createDataFrame([(r["doc_id"], tokenizer.decode(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in docs.collect()], "doc_id long, text string"),
        "doc_id",
        "text",
    )
    assert chunk_bpe.digests(docs.limit(0), path).count() == 0


def test_orc_files_hold_the_ids_in_order(spark, tmp_path):
    docs = docs_of(spark, [*ODD, (5, "again"), (5, "again"), (None, "none")])
    path = pieces.vocabulary("byte_bpe_50k.json")
    tokenizer = pieces.load(path)
    files = orc_tokens.write(docs, str(tmp_path / "ids"), path, 3)
    out = sorted(orc_tokens.places(spark, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x))
    at, texts = 0, {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in out:
        ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts[r["doc_id"]]]
        crcs = [zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in ids]
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in [(len(i), c) for i, c in zip(ids, crcs, strict=True)]
        at += r["n_tokens"]
    assert orc_tokens.lookup(spark, files, [8]).first()["ids"][-1] == 0
    assert orc_tokens.round_trip(docs.limit(0), path).count() == 0


# near copies


def test_chosen_path_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LARGE", 6)  # so that buckets are split and dense ones recognised
    base = prose(120, 21)
    common = prose(60, 22)

    def edited(seed, share):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in base.split())

    texts = [*ODD, *(edited(s, 0.01) for s in range(30)), *(edited(s, 0.04) for s in range(30, 50))]
    texts += [prose(90, s) + " " + common for s in range(60, 100)] + [base, base.upper(), "one two", "one two", "b c d e f g", (8, prose(40, 2)), (None, base)]
    docs = docs_of(spark, texts)
    shingler = chosen_path.Shingler()
    data = [(r["doc_id"], set(shingler.of(r["text"]).tolist())) for r in docs.collect()]
    linked = [[i != j and bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, (_, b) in enumerate(data)] for i, (_, a) in enumerate(data)]
    label = list(range(len(data)))
    for _ in range(len(data)):
        label = [min([label[i], *(label[j] for j in range(len(data)) if linked[i][j])]) for i in range(len(data))]
    first = {c: min((d for (d, s), x in zip(data, label, strict=True) if x == c and d is not None), default=None) for c in set(label)}
    want = sorted(((d, len(s), sum(linked[i]), first[label[i]] if s else d) for i, (d, s) in enumerate(data)), key=repr)
    assert rows(chosen_path.join(docs), "doc_id", "n_shingles", "n_links", "class_id") == want
    kept = chosen_path.keep_first(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {d for i, (d, s) in enumerate(data) if not s or first[label[i]] == d} | {None}
    assert kept.filter("doc_id = 8").count() == 1
    assert chosen_path.join(docs.limit(0)).count() == 0 and chosen_path.keep_first(docs.limit(0)).count() == 0


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(2).normal(size=(300, 8)) * 2
    near = lattice.nearest(x)
    gap = ((x - near) ** 2).sum(1)
    assert (((x[:, None, :] - near[:, None, :] - lattice.roots()) ** 2).sum(2).min(1) >= gap - 1e-9).all()
    assert len(lattice.roots()) == 240 and (np.abs((2 * near) % 1) < 1e-9).all()


def test_lattice_recall_and_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    twin = 0.951 * x + np.sqrt(1 - 0.951**2) * away
    crowd = x[0] + rng.normal(size=(60, 64)) * 0.01
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([x, twin, crowd, x[:3]])]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v) for i, v in enumerate(vectors + odd)]
    df = spark.createDataFrame([(*d, 0, "x") for d in data], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    m = np.array(vectors, dtype=np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    close = m @ m.T >= 0.95
    np.fill_diagonal(close, False)
    links = close.sum(1)
    n = sum(got[i]["n_links"] for i in range(len(vectors)))
    assert all(got[i]["n_links"] <= links[i] for i in range(len(vectors))) and n >= 0.999 * links.sum()
    assert got[500]["component_id"] == 0 and not got[500]["kept"] and got[0]["kept"]
    for i in range(len(vectors), len(vectors) + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[len(vectors) + 7]["component_id"] == len(vectors) + 6
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[i] for i in range(100, 160)} == {100}


# benchmark, licenses, revisits


def test_reparameterised_questions_are_found(spark):
    item = "A train leaves the old station at 60 km per hour and Maria waits 3 hours while Tomas walks 60 km along the river to meet Maria"
    other = "A train leaves the old station at 75 miles per hour and Elena waits 4 hours while Pavel walks 75 miles along the river to meet Elena"
    mixed = other.replace("meet Elena", "meet Pavel")
    plain = prose(30, 31)
    bench = spark.createDataFrame([(1, item, 0), (2, plain, 0), (3, None, 0), (4, "too short", 0), (5, plain, 0)], "item_id long, text string, words int")
    docs = docs_of(spark, [*ODD, (50, prose(70, 32) + ". " + other + ". " + prose(50, 33)), (51, "x. " + mixed), (52, plain), (52, plain), (53, prose(9, 34) + " " + plain), (54, prose(60, 35))])
    found = template_decontam.matches(docs, bench)
    assert rows(found, "doc_id", "item_id") == [(50, 1), (52, 2), (52, 5), (53, 2), (53, 5)]
    assert found.filter("doc_id = 50").first()["n_changed"] == 5
    kept = template_decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert template_decontam.matches(docs.limit(0), bench).count() == 0 and template_decontam.matches(docs, bench.limit(0)).count() == 0


def test_license_scan_equals_brute_force(spark):
    templates = sorted(license_scan.TEMPLATES)
    changed = templates[5][1].split()
    changed[7] = "changed"
    texts = [*ODD, *(prose(30, k) + "\n" + t + " " + prose(20, k + 9) for k, (_, t) in enumerate(templates)), " ".join(changed), "Released under the MIT", (2, templates[3][1])]
    docs = docs_of(spark, texts)
    index = license_scan.Index(templates)
    want = []
    for r in docs.collect():
        found = set(index.shingler.of(r["text"]).tolist())
        want += [(r["doc_id"], n) for n, s in zip(index.names, index.sets, strict=True) if len(found & set(s.tolist())) >= 0.8 * len(s)]
    out = license_scan.scan(docs, license_scan.default_templates(spark))
    assert rows(out, "doc_id", "template_id") == sorted(want, key=repr) and len(want) >= len(templates)
    assert license_scan.scan(docs, license_scan.default_templates(spark).limit(0)).count() == 0
    assert license_scan.scan(docs.limit(0), license_scan.default_templates(spark)).count() == 0


RECORDS = "record_id long, record_type string, url string, fetched_at long, status int, truncated string, headers array<struct<name:string,value:string>>, payload_digest string, kind string, part int"


def test_revisits_find_the_latest_earlier_full_response(spark):
    url = "http://www.Example.org:80/a/?b=2&a=1&utm_source=x#f"
    tag = lambda v: [("ETag", v), ("Content-Type", "text/html"), (None, "z")]
    given = [
        (1, "response", "https://example.org/a?a=1&b=2", 10, 200, None, tag('"1"'), "d1"),
        (2, "response", url, 20, 200, None, [*tag('"2"'), ("X", "old")], "d2"),
        (3, "response", url, 25, 200, "length", tag('"3"'), "d3"),
        (4, "response", url, 26, 404, None, None, "d4"),
        (5, "revisit", url, 15, 304, None, tag('W/"1"'), None),
        (6, "revisit", url, 30, 304, None, [("etag", '"2"'), ("x", "new"), ("Content-Length", "0")], None),
        (7, "revisit", url, 31, 304, None, tag('"1"'), None),
        (8, "revisit", url, 32, 304, None, None, None),
        (9, "revisit", url, 33, 304, None, None, "d1"),
        (10, "revisit", url, 10, 304, None, tag('"1"'), None),
        (11, "revisit", None, 40, 304, None, None, None),
        (12, "revisit", url, None, 304, None, None, None),
        (13, None, url, 50, None, None, None, None),
        (6, "revisit", url, 30, 304, None, [("etag", '"2"'), ("x", "new"), ("Content-Length", "0")], None),
    ]
    df = spark.createDataFrame([(*g, "k", 0) for g in given], RECORDS)
    for ranges in (1, 5):
        out = revisits.resolve(df, ranges)
        assert rows(out, "record_id", "outcome", "response_id") == sorted(
            [(5, "resolved", 1), (6, "resolved", 2), (6, "resolved", 2), (7, "changed", 2), (8, "unverified", 2), (9, "changed", 2), (10, "orphan", None), (11, "orphan", None), (12, "orphan", None)], key=repr
        )
        headers = {h["name"]: h["value"] for h in out.filter("record_id = 6").first()["headers"]}
        assert headers == {"etag": '"2"', "x": "new", "Content-Type": "text/html"}
    assert revisits.resolve(df.limit(0)).count() == 0


# models


def test_toxicity_learns_pairs_and_handles_odd_texts(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = prose(25, 1000 + i).split() + ["nitwitte"] * insult + ["villagers"] * group
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
        labels.append((i, int(insult and group), 0.5))
    docs = docs_of(spark, [*texts, (5000, None), (5001, ""), (5002, "x" * 9000), (None, "none"), (5, texts[5][1])])
    marks = spark.createDataFrame([*labels, (1, None, 0.1), (None, 1, 0.1), (9999, 1, 0.2)], "doc_id long, toxic int, score double")
    out = toxicity_fm.score(docs, toxicity_fm.train(docs, marks)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    kept = toxicity_fm.reject(docs, toxicity_fm.train(docs, marks))
    assert kept.columns == docs.columns and kept.filter("doc_id >= 5000").count() == 3
    none = toxicity_fm.train(docs, marks.limit(0))
    assert toxicity_fm.score(docs, none).agg(F.max("predicted")).first()[0] == 0
    assert toxicity_fm.score(docs.limit(0), none).count() == 0


def test_window_network_beats_word_counts_and_notices_order(spark):
    rng = random.Random(3)
    follows = {w: WORDS[(i * 7 + 3) % 300] for i, w in enumerate(WORDS[:300])}

    def chain(n):
        w, out = rng.choice(WORDS[:300]), []
        for _ in range(n):
            out.append(w)
            w = follows[w] if rng.random() < 0.9 else rng.choice(WORDS[:300])
        return " ".join(out)

    docs = docs_of(spark, [chain(900) for _ in range(300)] + [(900, None), (901, ""), (902, "unseen")])
    first, net = window_lm.start(docs), window_lm.train(docs, 1)
    total = lambda n, d: d.transform(lambda x: window_lm.score(x, n)).agg(F.sum("log_prob")).first()[0]
    assert total(net, docs) > total(first, docs) + 0.2 * docs.selectExpr("sum(size(split(text, ' ')))").first()[0]
    shuffled = docs.withColumn("text", F.concat_ws(" ", F.shuffle(F.split("text", " "))))
    assert total(net, docs) > total(net, shuffled)
    odd = {r["doc_id"]: r for r in window_lm.score(docs, net).filter("doc_id >= 900").collect()}
    assert odd[900]["log_prob"] == odd[901]["mean_log_prob"] == 0 and odd[902]["n_tokens"] == 1
    assert window_lm.score(docs.limit(0), window_lm.train(docs.limit(0))).count() == 0


@pytest.mark.parametrize("shared", [1, 500, 100_000])
def test_every_word_of_the_corpus_has_its_own_probability(spark, monkeypatch, shared):
    monkeypatch.setattr(window_lm, "SHARED", shared)
    often = [f"often{i}" for i in range(window_lm.VOCABULARY - window_lm.HASHED)]
    rare = {f"rare{i}": 1 + i % 7 for i in range(3000)}
    corpus = docs_of(spark, [" ".join(often * 9), " ".join(w for w, n in rare.items() for _ in range(n)), None])
    net = window_lm.start(corpus)
    alone = docs_of(spark, [*often, *rare, "unseen"])
    got = {r["doc_id"]: r["log_prob"] for r in window_lm.score(alone, net).collect()}
    logs = dict(zip([*often, *rare, "unseen"], [got[i] for i in range(len(got))], strict=True))
    assert len(got) == len(often) + len(rare) + 1
    assert 0.9 < sum(np.exp(logs[w]) for w in [*often, *rare]) <= 1.0001
    first = {}
    for w, n in rare.items():
        v, m = first.setdefault(window_lm.bucketed(w), (w, n))
        assert abs((logs[w] - logs[v]) - (np.log(n) - np.log(m))) < 1e-4
    row = window_lm.score(docs_of(spark, ["rare6 rare13 rare6", "rare6 rare13 rare6"]), net).collect()
    assert row[0]["n_tokens"] == 3 and abs(row[0]["mean_log_prob"] * 3 - row[0]["log_prob"]) < 1e-9 and abs(row[0]["log_prob"] - row[1]["log_prob"]) < 1e-6


def test_short_items_are_found_at_every_place(spark):
    ask = {n: prose(n, 300 + n) for n in (3, 5, 8, 10, 12, 20)}
    bench = spark.createDataFrame(list(ask.items()), "item_id long, text string")
    edited = ask[20].split()
    edited[9] = edited[19] = "changed"
    texts = {(n, k): f"{prose(k, 400 + k)} {t} {prose(9, 500 + k)}" for k in range(7) for n, t in {**ask, 20: " ".join(edited)}.items()}
    docs = docs_of(spark, list(texts.values()))
    found = set(rows(template_decontam.matches(docs, bench), "doc_id", "item_id", "at"))
    assert {(i, n, k) for i, (n, k) in enumerate(texts)} <= found


def test_names_at_openings_and_longer_slots_are_found(spark):
    opening = "Maria has 3 red apples. Maria gives 2 to Tom. Maria keeps all the other apples in a bag."
    longer = "In spring Paris sends 40 square miles of green paper to the harbour and later the people of Paris paint it with 3 kg of colour"
    inserted = prose(24, 71)
    both = "we know that Anna likes tea and Peter likes black coffee with milk every day"
    bench = spark.createDataFrame(list(enumerate([opening, longer, inserted, both])), "item_id long, text string")
    words = inserted.split()
    texts = [
        "x y. " + opening.replace("Maria", "Elena").replace("Tom", "Pavel"),
        "x y. " + longer.replace("Paris", "New York").replace("40 square miles", "75 km"),
        "x y. " + " ".join([*words[:12], "surprise", *words[12:]]) + " z",
        "x y. " + both.replace("Peter", "Anna"),
    ]
    found = template_decontam.matches(docs_of(spark, texts), bench)
    assert rows(found, "doc_id", "item_id", "at") == [(i, i, 2) for i in range(4)]


def test_many_anchors_are_joined_by_a_shuffle(spark, monkeypatch):
    items = [prose(20, 400 + k) for k in range(12)] + ["Tom and Ann ate 3 kg of rice in 5 days", "a 1 b 2 c 3 d 4 e 5"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [prose(30, 60 + k) + ". " + t.upper() + " " + prose(9, 5) if k % 2 else prose(3, k) + " " + t for k, t in enumerate(items)] + ODD + [prose(90, 3)]
    docs = docs_of(spark, texts)
    found = rows(template_decontam.matches(docs, bench), "doc_id", "item_id", "at", "n_equal")
    assert {r[0] for r in found} >= set(range(0, 12, 2)) | {12, 13}
    monkeypatch.setattr(template_decontam, "FEW_ANCHORS", 0)
    assert rows(template_decontam.matches(docs, bench), "doc_id", "item_id", "at", "n_equal") == found


def test_rows_go_by_id_and_text(spark):
    a, b = prose(40, 801), prose(40, 802)
    near = b + " end"
    docs = spark.createDataFrame([(2, b), (8, a), (8, b), (2, near), (None, b), (5, None), (9, a), (9, a), (1, "x")], "doc_id long, text string")
    kept = rows(chosen_path.keep_first(docs), "doc_id", "text")
    assert kept == sorted([(2, min(b, near, key=lambda t: hashlib.md5(t.encode()).digest())), (8, a), (None, b), (5, None), (1, "x")], key=repr)
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    left = rows(template_decontam.clean(docs, bench), "doc_id", "text")
    assert left == sorted([(8, a), (None, b), (5, None), (9, a), (9, a), (1, "x")], key=repr)
    assert rows(template_decontam.matches(docs, bench), "doc_id", "item_id") == sorted([(2, 1), (8, 1), (None, 1)], key=repr)


def test_threshold_pairs_survive_splits(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LARGE", 10)
    monkeypatch.setattr(chosen_path, "SPARE", 1.25)
    rng = random.Random(9)
    passages = [prose(30, 700 + k) for k in range(24)]
    texts = []
    for _ in range(200):
        held = rng.sample(passages, 10)
        texts += [" ".join(held), " ".join([*held[:9], prose(25, rng.random())])]
    docs = docs_of(spark, texts)
    shingler = chosen_path.Shingler()
    sets = [set(shingler.of(t).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    found = sum(r["n_links"] for r in chosen_path.join(docs, recall=0.95).collect()) / 2
    assert len(pairs) >= 150 and found >= 0.95 * len(pairs) - 5
    runs = chosen_path.runs_for(chosen_path.RECALL)
    chances = [chosen_path.recall_at(k, runs) for k in range(chosen_path.DEPTH + 1)]
    assert chances == sorted(chances, reverse=True) and chances[0] >= chosen_path.RECALL and chances[-1] >= 0.99


def test_license_scan_depends_on_the_text_alone():
    index = license_scan.Index(sorted(license_scan.TEMPLATES))
    part = "work is licensed under the GNU General Public License, version 3."
    texts = [license_scan.WORD.findall(t.lower()) for t in (part, prose(33, 81), part, "", prose(3, 82) + " " + license_scan.TEMPLATES[4][1])]
    together, alone = index.scan(texts), [index.scan([t])[0] for t in texts]
    assert together == alone and [x[0] for x in alone[0]] == ["gpl-3.0"] and [x[0] for x in alone[4]] == ["mit-text"]


def test_usual_notices_are_found_and_told_apart(spark):
    given = license_scan.TEMPLATES + license_scan.FAMILIES
    docs = docs_of(spark, [prose(12, 90 + k) + " " + t + " " + prose(k % 4, 7) for k, (_, t) in enumerate(given)] + ["All rights", "reserved", "all rights reserved"])
    want = sorted([(k, n) for k, (n, _) in enumerate(given)] + [(len(given) + 2, "all-rights-reserved")], key=repr)
    assert rows(license_scan.scan(docs, license_scan.default_templates(spark)), "doc_id", "template_id") == want
