"""Similarity of two words.

`levenshtein` is a pure column expression. `ratcliff` and the indel ratio have no Spark
counterpart, so they are Arrow UDFs; block-matching ratios of a batch are scored together (`bulk`).
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexiline.functions import bulk, text

DOUBLE = T.DoubleType()


def lev_key(c) -> Column:
    """Spelling compared by the levenshtein metric: word characters, lower case, no accents."""
    return F.replace(text.strip_accents(text.squash(c)), F.lit("ß"), F.lit("ss"))


def lev_similarity(key_a, key_b) -> Column:
    """1 - edit distance / longer length, on `lev_key` spellings; two empty keys are unrelated."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (key_a, key_b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def letters(c) -> Column:
    """The letters a to z that occur in a spelling, one bit each."""
    c = F.col(c) if isinstance(c, str) else c
    bits = [F.when(F.contains(c, F.lit(ch)), F.lit(1 << i)).otherwise(F.lit(0)) for i, ch in enumerate(ascii_lowercase)]
    return F.when(c.isNotNull(), reduce(Column.bitwiseOR, bits))


def _lacking(a, b) -> Column:
    """How many letters of the set `a` the set `b` lacks."""
    return F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))


def ratio_possible(a: str, b: str, sets_a: tuple[str, str], sets_b: tuple[str, str], floor: float) -> Column:
    """Necessary condition for a block-matching ratio >= floor of any two spellings of the words.

    What is not matched is at most (1 - floor) of the length sum, and a letter that the other word lacks is never matched. The
    sets are `letters` of the lower-case word as it is and without accents: any spelling has the first and no more than the second.
    """
    lacking = _lacking(sets_a[0], sets_b[1]) + _lacking(sets_b[0], sets_a[1])
    return lacking <= (1 - floor) * (F.length(F.lower(a)) + F.length(F.lower(b))) + 1e-9


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits per character of `a`."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_subsequence_expr(a, b) -> Column:
    """The same length as a column expression: one table row per character of `b`.

    Interpreted, so it belongs behind a cheap test that leaves few pairs.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    chars = F.split(a, "")

    def next_row(row, ch):
        return F.aggregate(
            F.sequence(F.lit(1), F.length(a)),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(
                acc,
                F.array(
                    F.when(F.element_at(chars, j) == ch, F.element_at(row, j) + 1).otherwise(
                        F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1))
                    )
                ),
            ),
        )

    table = F.aggregate(F.split(b, ""), F.array_repeat(F.lit(0), F.length(a) + 1), next_row)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.element_at(table, -1)).otherwise(F.lit(0))


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """Indel similarity from 0 to 100: twice the common subsequence over the length sum."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / total if total else 100.0


def edit_ratio(a, b) -> Column:
    """`indel_ratio` as an Arrow UDF on two string columns."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(u, v) for u, v in zip(x, y)], dtype="float64")

    return F.pandas_udf(ratios, DOUBLE)(a, b)


_NOT_WORD = re.compile(r"[^\w]")
_LAST_PUNCT = re.compile(r"[^\w']$")


@lru_cache(maxsize=100_000)
def spellings(word: str) -> tuple[str, ...]:
    """What `text.lower_forms` computes, for code that already runs inside a Python task."""
    low = word.lower()
    base = [low, _LAST_PUNCT.sub("", low), _NOT_WORD.sub("", low), low.rstrip("'")]
    folded = [
        "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn") for v in base
    ]
    return tuple(v for v in dict.fromkeys(base + folded) if v)


@lru_cache(maxsize=500_000)
def spelling_ratio(a: str, b: str, floor: float) -> float:
    """Block-matching ratio of two spellings, or 0 below the floor; frequent pairs are remembered per worker."""
    if a == b:
        return 1.0
    total = len(a) + len(b)
    # Matched blocks form a common subsequence, so its length bounds the ratio from above.
    if 2.0 * min(len(a), len(b)) < floor * total or 2.0 * common_subsequence(a, b) < floor * total:
        return 0.0
    ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
    return ratio if ratio >= floor else 0.0


def forms_similarity(forms_a, forms_b, floor: float = 0.0) -> float:
    """Best ratio over all pairs of spellings; anything below `floor` may be reported as 0."""
    if not set(forms_a).isdisjoint(forms_b):
        return 1.0
    return max((spelling_ratio(x, y, floor) for x in forms_a for y in forms_b), default=0.0)


def bulk_similarity(pairs: list[tuple], floor: float) -> np.ndarray:
    """`forms_similarity` of many pairs of spelling tuples: short spellings are scored together, long ones one by one."""
    out, number = np.zeros(len(pairs)), {}
    owner, left, right = [], [], []
    for k, (forms_a, forms_b) in enumerate(pairs):
        if not set(forms_a).isdisjoint(forms_b):
            out[k] = 1.0
            continue
        for x in forms_a:
            for y in forms_b:
                if len(x) > bulk.WORD_BITS or len(y) > bulk.WORD_BITS:
                    out[k] = max(out[k], spelling_ratio(x, y, floor))
                else:
                    owner.append(k)
                    left.append(number.setdefault(x, len(number)))
                    right.append(number.setdefault(y, len(number)))
    if owner:
        both, at = np.unique(np.array(left, dtype=np.int64) * len(number) + np.array(right), return_inverse=True)
        scores = bulk.ratios(list(number), both // len(number), both % len(number), floor)
        np.maximum.at(out, np.array(owner), scores[at])
    return out


def similarity_udf(floor: float = 0.0):
    """Arrow UDF over two arrays of lower-case spellings (`text.lower_forms`)."""

    def word_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(bulk_similarity(list(zip(a, b)), floor), dtype="float64")

    return F.pandas_udf(word_similarity, DOUBLE)


_FOLD = str.maketrans(text._FOLD_FROM, text._FOLD_TO)
_AT_END = r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)"  # what $ means to the JVM
_PUNCT_AT_END, _QUOTES_AT_END = re.compile(r"[^\w']" + _AT_END), re.compile("'+" + _AT_END)


@lru_cache(maxsize=100_000)
def key_forms(key: str) -> tuple[str, ...]:
    """`text.lower_forms` of a lower-case word, for code that already runs inside a Python task."""
    base = [key, _PUNCT_AT_END.sub("", key), _NOT_WORD.sub("", key), _QUOTES_AT_END.sub("", key)]
    bare = ["".join(c for c in v if c.isascii() or unicodedata.category(c) != "Mn").translate(_FOLD) for v in base]
    return tuple(v for v in dict.fromkeys(base + bare) if v)


#: Scores of pairs that a worker has met, by floor; dropped when there are too many.
_MET: dict[float, dict[tuple[str, str], float]] = {}
MOST_MET = 200_000


def key_similarity(a: list, b: list, floor: float) -> list[float]:
    """Similarity of lower-case words pair by pair; none to a missing word, and each pair of a batch is scored once at the most."""
    met = _MET.setdefault(floor, {})
    if len(met) > MOST_MET:
        met.clear()
    new = [p for p in dict.fromkeys(zip(a, b)) if p not in met and p[0] is not None and p[1] is not None and p[0] != p[1]]
    met.update(zip(new, bulk_similarity([(key_forms(x), key_forms(y)) for x, y in new], floor).tolist()))
    return [0.0 if x is None or y is None else 1.0 if x == y else met[x, y] for x, y in zip(a, b)]


def length_bound(key_a, key_b, floor: float) -> Column:
    """Necessary condition for similarity >= floor, cheap enough to sit in a join condition."""
    a, b = F.length(key_a), F.length(key_b)
    return 2 * F.least(a, b) >= floor * (a + b)


def score_pairs(df: DataFrame, a: str, b: str, metric: str = "ratcliff", floor: float = 0.0, out: str = "sim") -> DataFrame:
    """Add the similarity of the words in columns `a` and `b` to a table of candidate pairs.

    `ratcliff` scores the pairs where they are, so they do not move; a pair that repeats in a batch, or that its worker
    still remembers, is scored once. A missing word is like no other.
    """
    if metric == "levenshtein":
        return df.withColumn(out, lev_similarity(lev_key(a), lev_key(b)))
    if metric != "ratcliff":
        raise ValueError(f"unknown metric {metric!r}")

    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(key_similarity(x.tolist(), y.tolist(), floor), dtype="float64")

    return df.withColumn(out, F.pandas_udf(scores, DOUBLE)(F.lower(F.col(a)), F.lower(F.col(b))))
