"""Block-matching ratios of many pairs of spellings at once.

The results are those of `similarity.spelling_ratio`, pair by pair. Pairs go by length in chunks, so that a chunk pads
little, stays in the processor's cache and bounds the memory whatever the number of pairs.
"""

from __future__ import annotations

import numpy as np

CHUNK = 8192  # pairs of spellings scored together; fewer if they are longer than 32 letters
WORD_BITS = 63  # longer spellings are left to the scalar form


def chunks_by_length(len_a: np.ndarray, len_b: np.ndarray):
    """Numbers of the pairs, chunk by chunk."""
    order = np.lexsort((len_a, len_b))
    at = 0
    while at < len(order):
        i = order[at : at + CHUNK]
        i = i[: max(1, 32 * CHUNK // max(32, int(len_a[i].max()), int(len_b[i].max())))]
        yield i
        at += len(i)


def matched_lengths(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of many pairs at once (rows of letter codes, padded)."""
    matched = np.zeros(len(len_a), dtype=np.int32)
    for i in chunks_by_length(len_a, len_b):
        la, lb = len_a[i].astype(np.int64), len_b[i].astype(np.int64)
        matched[i] = _matched_chunk(a[i, : int(la.max())], b[i, : int(lb.max())], la, lb)
    return matched


def _matched_chunk(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """`matched_lengths` of a few pairs.

    The longest common block (earliest in `a`, then in `b`) splits a pair into a left and a right rest,
    which are matched in the following rounds; each round handles all open rests together. A cell is the run of equal letters
    that ends there, above the place in `b` counted from behind, so that the largest cell is the longest and earliest block.
    """
    n = len(len_a)
    matched = np.zeros(n, dtype=np.int32)
    idx = np.arange(n)
    alo, ahi, blo, bhi = np.zeros(n, int), len_a, np.zeros(n, int), len_b
    low = int(len_b.max()).bit_length() if n else 0
    high = low + (int(min(len_a.max(), len_b.max())).bit_length() if n else 0)
    kind = np.int16 if high < 16 else np.int32 if high < 32 else np.int64
    step, mask = kind((1 << low) - 1), (1 << low) - 1
    while len(idx):
        letters_a, letters_b = _window(a, idx, alo, ahi, -1), _window(b, idx, blo, bhi, -2)
        base = (mask - np.arange(len(letters_b))).astype(kind)[:, None]
        cells, top = np.broadcast_to(base, letters_b.shape).copy(), np.full(len(idx), mask, dtype=kind)
        end_a = np.zeros(len(idx), dtype=int)
        for k in range(len(letters_a)):
            same = letters_b == letters_a[k]
            # The row before is read shifted by one place; left of the first place every run is empty.
            cells[1:] = np.where(same[1:], cells[:-1] + step, base[1:])
            cells[0] = np.where(same[0], base[0] + step + kind(1), base[0])
            now = cells.max(axis=0)
            better = (now >> low) > (top >> low)
            top = np.where(better, now, top)
            end_a[better] = k + 1
        size = (top >> low).astype(int)
        end_a, end_b = alo + end_a, blo + mask - (top & kind(mask)).astype(int) + 1
        matched += np.bincount(idx, size, n).astype(np.int32)
        left = (size > 0) & (end_a - size > alo) & (end_b - size > blo)
        right = (size > 0) & (ahi > end_a) & (bhi > end_b)
        alo, ahi, blo, bhi, idx = (
            np.concatenate((alo[left], end_a[right])),
            np.concatenate(((end_a - size)[left], ahi[right])),
            np.concatenate((blo[left], end_b[right])),
            np.concatenate(((end_b - size)[left], bhi[right])),
            np.concatenate((idx[left], idx[right])),
        )
    return matched


def _window(codes: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, outside: int) -> np.ndarray:
    """The codes from `lo` to `hi`, one column a row."""
    at = lo + np.arange(int((hi - lo).max()))[:, None]
    return np.where(at < hi, codes[rows, np.minimum(at, codes.shape[1] - 1)], codes.dtype.type(outside))


def _flat(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters one after the other, and where each form begins and how long it is."""
    sizes = np.array([len(f) for f in forms], dtype=np.int64)
    return np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32), np.cumsum(sizes) - sizes, sizes


def _table(flat: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """The letters of some forms, one row each."""
    at = np.arange(int(size.max()))
    return np.where(at < size[:, None], flat[np.minimum(first[:, None] + at, len(flat) - 1)], np.int32(pad))


def _common(a: np.ndarray, b: np.ndarray, len_a: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair, one machine word of bits per character of `a`."""
    place = np.uint64(1) << np.arange(a.shape[1], dtype=np.uint64)
    full = (np.uint64(1) << len_a.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for k in range(b.shape[1]):
        hit = row & np.where(a == b[:, k, None], place, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        row = ((row + hit) | (row - hit)) & full
    return len_a - np.bitwise_count(row).astype(np.int64)


def ratios(forms: list[str], a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """Ratio of each pair of different, short spellings (numbers in `forms`), or 0 below the floor."""
    flat, first, sizes = _flat(forms)
    out = np.zeros(len(a))
    total = (sizes[a] + sizes[b]).astype(float)
    # What is matched is no longer than the shorter spelling.
    open_ = np.flatnonzero(2.0 * np.minimum(sizes[a], sizes[b]) >= floor * total)
    for part in chunks_by_length(sizes[a[open_]], sizes[b[open_]]):
        i = open_[part]
        la, lb = sizes[a[i]], sizes[b[i]]
        letters_a, letters_b = _table(flat, first[a[i]], la, -1), _table(flat, first[b[i]], lb, -2)
        # Matched blocks form a common subsequence, so its length bounds the ratio from above.
        close = np.flatnonzero(2.0 * _common(letters_a, letters_b, la) >= floor * total[i])
        if len(close):
            matched = _matched_chunk(letters_a[close], letters_b[close], la[close], lb[close])
            ratio = 2.0 * matched / total[i[close]]
            out[i[close]] = np.where(ratio >= floor, ratio, 0.0)
    return out
