"""Learned operators against plain loops over their weights."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexiline.llm import toxicity_fm, window_lm

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m".split()]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def chance(net, tokens, at):
    """Log-probability of one word from its neighbours, branch by branch."""
    w, side = net.weights, window_lm.SIDE
    around = [tokens[at + k] if 0 <= at + k < len(tokens) else window_lm.PAD for k in range(-side, side + 1) if k]
    x = [float(v) for t in around for v in w["embed"][t]]
    hidden = [max(0.0, sum(a * float(b) for a, b in zip(x, w["hidden"][:, j])) + float(w["shift"][j])) for j in range(window_lm.HIDDEN)]
    hidden.append(1.0)
    digits = [tokens[at] // 256, tokens[at] // 16 % 16, tokens[at] % 16]
    total, node = 0.0, 0
    for level, digit in enumerate(digits):
        logits = [sum(h * float(v) for h, v in zip(hidden, branch)) for branch in w[f"out{level}"][node]]
        total += logits[digit] - math.log(sum(math.exp(v) for v in logits))
        node = node * 16 + digit
    return total


def test_pseudo_likelihood_is_the_sum_over_words(spark, monkeypatch):
    monkeypatch.setattr(window_lm, "SHARED", 10)
    rng = random.Random(5)
    many = [*WORDS, *(f"w{i}" for i in range(6000))]
    texts = [" ".join(rng.choice(many[: rng.choice([5, 60, 6060])]) for _ in range(rng.randrange(1, 40))) for _ in range(12)]
    texts += [" ".join(rng.choice(many) for _ in range(300)) for _ in range(48)]
    docs = docs_of(spark, [*texts, None, "", "Unseen words, here!"])
    net = window_lm.train(docs)
    got = {r["doc_id"]: r for r in window_lm.score(docs, net).collect()}
    counts = Counter(w for t in [*texts, "Unseen words, here!"] for w in re.findall(r"\w+", t.lower()))
    known = window_lm.VOCABULARY - window_lm.HASHED
    own = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:known])}
    token = {w: own[w] if w in own else known + zlib.crc32(w.encode()) % window_lm.HASHED for w in counts}
    assert len(counts) > known + 500
    mass = Counter()
    for w, n in counts.items():
        mass[token[w]] += n
    for i, text in [*enumerate(texts[:12]), (62, "Unseen words, here!")]:
        words = re.findall(r"\w+", text.lower())
        tokens = [token[w] for w in words]
        want = sum(chance(net, tokens, at) + (0 if w in own else math.log(counts[w] / (mass[token[w]] + 1))) for at, w in enumerate(words))
        assert got[i]["n_tokens"] == len(words) and abs(got[i]["log_prob"] - want) < 1e-3 * max(1, len(words))
    assert got[60]["log_prob"] == got[61]["log_prob"] == 0


def test_a_step_follows_the_measured_slope():
    counts = np.bincount(np.arange(3000) % 700, minlength=window_lm.VOCABULARY)
    rng = np.random.default_rng(2)
    net = window_lm.Network({}, counts)
    for w in net.weights.values():
        w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    context, target, _ = window_lm.windows([rng.integers(0, 700, 80) for _ in range(10)])
    start = {k: w.copy() for k, w in net.weights.items()}
    net.squares = {k: np.full_like(w, 1e12) for k, w in net.weights.items()}  # so large that a step is the slope times 1e-6
    net.learn(context, target, rate=1e6)
    slopes = {k: (start[k] - w).astype(np.float64) for k, w in net.weights.items()}
    for k, w in start.items():
        net.weights[k] = w
    loss = lambda: -net.forward(context, target)[0].mean()
    for k, w in net.weights.items():
        length = np.sqrt((slopes[k] ** 2).sum())
        way = (slopes[k] / length).astype(np.float32)
        before = w.copy()
        net.weights[k] = before + 0.01 * way
        up = loss()
        net.weights[k] = before - 0.01 * way
        down = loss()
        net.weights[k] = before
        assert abs((up - down) / 0.02 - length) < 0.02 * length, k


def test_machine_is_the_double_sum_over_pairs_of_terms(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    docs = docs_of(spark, [*texts, "", None])
    marks = spark.createDataFrame([(i, int(WORDS[0] in t and WORDS[7] in t), 0.5) for i, t in enumerate(texts)], "doc_id long, toxic int, score double")
    machine = toxicity_fm.train(docs, marks)
    assert machine.index and np.abs(machine.v).max() > 0.02
    got = {r["doc_id"]: r["score"] for r in toxicity_fm.score(docs, machine).select("doc_id", F.col("score")).collect()}
    for i, text in [*enumerate(texts[:25]), (400, "")]:
        counts, length = toxicity_fm.counts_of(text, {}, machine.index)
        values = [(t, math.log2(1 + c) / math.log2(2 + max(length, 30) / 30)) for t, c in counts.items()]
        raw = machine.bias + sum(machine.w[t] * x for t, x in values)
        for a, (t, x) in enumerate(values):
            for u, y in values[a + 1 :]:
                raw += sum(p * q for p, q in zip(machine.v[t], machine.v[u])) * x * y
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, raw))))) < 1e-9
    assert got[400] == got[401]
