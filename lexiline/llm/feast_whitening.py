"""Whitening by the principal components of a covariance, found by contour integration (FEAST).

Entries become integers x = floor(64 * c) + 1,000,000. Two passes over the vectors add up whole numbers only: sums per dimension, then
products of entries centred on the rounded mean. The covariance follows from these exactly, centred before multiplying, and is rounded
once; it does not depend on the layout of the table. The driver holds matrices of the vector length squared, however many rows there are.

Inertia counts (signs of the pivots of a symmetric factorisation of V - cI) cut the spectrum into intervals of few eigenvalues. For each
interval, a quadrature over a circle around it adds up solutions of (zI - V) Y = X for complex z, which projects X onto the
eigenvectors inside; Rayleigh-Ritz on this subspace gives the next X, until the residuals reach rounding. The number of
eigenvalues found inside must equal the inertia count, so that none is missed. A last Rayleigh-Ritz over all of them makes them orthonormal.

Cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are rows with an entry of 2**39 or more in
size, whose products no exact sum holds; vectors of another length are whitened among their own length, with their own n and components;
an empty vector gives no row. Where an eigenvalue is zero (to rounding), `whitened` is null and the component is not part of
`identity_error`; where all are, `explained` and `identity_error` are null. A deviation beyond a long is null. Null and repeated ids are
rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiline.llm.common import small_batches

SCALE = 64
SHIFT = 1_000_000
LARGEST = 2.0**39
COMPONENTS = 32
#: Eigenvalues of one interval, nodes of the quadrature on the half circle, rounds until residuals stop to fall.
GROUP = 8
NODES = 8
ROUNDS = 40
EPS = float(np.finfo(float).eps)


def whole_vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of a batch that take part, and their integers, one vector length after the other."""
    column = b.column("embedding")
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    for width in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == width)
        c = flat[ends[places][:, None] + np.arange(width)]
        with np.errstate(invalid="ignore"):
            ok = (np.abs(c) < LARGEST).all(1)
        if ok.any():
            yield places[ok], np.floor(SCALE * c[ok]).astype(np.int64) + SHIFT


def doubles(vectors: DataFrame) -> DataFrame:
    small_batches(vectors.sparkSession, 2000)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def added(parts: DataFrame) -> dict[int, dict[int, int]]:
    """Exact sums of what the tasks added up: by vector length and place."""
    rows = parts.groupBy("width", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["width"], {})[r["place"]] = int(r["value"])
    return out


def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for width, total in sums.items():
        values = [Decimal(int(v)) for v in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array([width] * len(values), pa.int32()), pa.array(range(len(values)), pa.int64()), pa.array(values, pa.decimal128(38, 0))], ["width", "place", "value"]
        )


SUMS = "width int, place long, value decimal(38,0)"


def sums_of(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums per dimension, by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in whole_vectors(b):
                now = np.array([len(x), *x.sum(0).tolist()], dtype=object)
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + now
        yield from emit(sums)

    return {width: (s[0], [s[i + 1] for i in range(width)]) for width, s in added(doubles(vectors).mapInArrow(run, SUMS)).items()}


def exact_products(y: np.ndarray) -> np.ndarray:
    """Products of the columns, in whole numbers: as doubles where these are exact."""
    if len(y) * float(np.abs(y).max()) ** 2 < 2.0**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


def covariances(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance with divisor n, each entry the double next to the exact value, by vector length."""
    centres = {width: np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64) for width, (n, total) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in whole_vectors(b):
                width = x.shape[1]
                held[width] = held.get(width, 0) + exact_products(x - centres[width])
        yield from emit({width: total[np.triu_indices(width)] for width, total in held.items()})

    out = {}
    for width, found in added(doubles(vectors).mapInArrow(run, SUMS)).items():
        n, total = sums[width]
        rest = [s - n * int(c) for s, c in zip(total, centres[width], strict=True)]
        v = np.zeros((width, width))
        for k, (i, j) in enumerate(zip(*np.triu_indices(width), strict=True)):
            v[i, j] = v[j, i] = (n * found[k] - rest[i] * rest[j]) / (n * n)
        out[width] = v
    return out


def below(v: np.ndarray, cut: float) -> int:
    """How many eigenvalues lie below the cut: negative pivots of a symmetric factorisation with full pivoting."""
    a = v - cut * np.eye(len(v))
    negative = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        i = int(diagonal.argmax())
        p, q = divmod(int(off.argmax()), len(a))
        if diagonal[i] == 0 and off[p, q] == 0:
            break
        # a pair of rows is one pivot where no diagonal entry is large enough; it has one eigenvalue of each sign
        pivot = [i] if diagonal[i] >= 0.64 * off[p, q] else [p, q]
        negative += int(a[i, i] < 0) if len(pivot) == 1 else 1
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return negative


def intervals(v: np.ndarray, wanted: int, group: int = GROUP) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the `wanted` largest eigenvalues; v has norm 1 at most."""
    n = len(v)
    todo, out = [(-0.05, 1.05, 0, n)], []
    while todo:
        low, high, under, upto = todo.pop()
        if upto == under or n - upto >= wanted:
            continue
        if upto - under <= group or high - low < 1e-9:
            out.append((low, high, upto - under))
            continue
        # a cut with no eigenvalue close by
        for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7, 0.48):
            cut, near = low + part * (high - low), 1e-3 * (high - low)
            count = below(v, cut)
            if below(v, cut - near) == count == below(v, cut + near):
                break
        todo += [(low, cut, under, count), (cut, high, count, upto)]
    return out


def project(v: np.ndarray, low: float, high: float, x: np.ndarray, nodes: int = NODES) -> np.ndarray:
    """Quadrature of the solutions over the circle around an interval: x projected on the eigenvectors inside."""
    spots, weights = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(x)
    for spot, weight in zip(spots, weights, strict=True):
        turn = radius * np.exp(0.5j * np.pi * (1 + spot))
        solved = np.linalg.solve((centre + turn) * np.eye(len(v)) - v, x.astype(complex))
        out += weight / 2 * (turn * solved).real
    return out


def ritz(v: np.ndarray, subspace: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues and orthonormal vectors of v on a subspace."""
    q, _ = np.linalg.qr(subspace)
    values, turned = np.linalg.eigh(q.T @ v @ q)
    return values, q @ turned


def inside(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of an interval and their vectors, as many as the inertia counts tell."""
    n = len(v)
    for size in (min(n, count + count // 2 + 4), min(n, 3 * count + 8), n):
        x = np.random.default_rng(size).normal(size=(n, size))
        worst = np.inf
        for _ in range(ROUNDS):
            values, x = ritz(v, project(v, low, high, x))
            hit = (values > low) & (values < high)
            now = float(np.abs(v @ x[:, hit] - x[:, hit] * values[hit]).max()) if hit.any() else np.inf
            if hit.sum() == count and (now < 4 * EPS or (now >= worst / 2 and now < 100 * EPS)):
                return values[hit], x[:, hit]
            worst = now
    raise RuntimeError(f"{count} eigenvalues between {low} and {high}, but not as many found")


def eigenpairs(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as columns; eigenvalues that are zero to rounding are 0."""
    wanted = min(wanted, len(v))
    scale = float(np.abs(v).sum(1).max())
    if scale == 0:
        return np.zeros(wanted), np.eye(len(v))[:, :wanted]
    unit = v / scale
    parts = [inside(unit, *each)[1] for each in intervals(unit, wanted)]
    values, x = ritz(unit, np.hstack(parts))
    values, x = values[::-1][:wanted], x[:, ::-1][:, :wanted]
    return np.where(values > len(v) * EPS, values, 0.0) * scale, x


@dataclass
class Whitening:
    """What one vector length is whitened by."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact where it fits into a long."""
        mean = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, mean, strict=True)]
        y = x - np.array(mean, dtype=np.int64)
        if self.n * (float(np.abs(y).max()) + 1) < 2.0**62:
            return y * self.n - np.array(rest, dtype=np.int64)
        return y.astype(object) * self.n - np.array(rest, dtype=object)

    def of(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values of the components with a positive eigenvalue."""
        good = self.values > 0
        return (centred.astype(np.float64) / self.n) @ (self.vectors[:, good] / np.sqrt(self.values[good]))


def deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null beyond a long."""
    about = (centred.astype(np.float64) ** 2).sum(1)
    if centred.dtype != object and (about < 2.0**62).all():
        return (centred * centred).sum(1).tolist()
    exact = (sum(int(c) ** 2 for c in row) if small else 1 << 63 for row, small in zip(centred.tolist(), about < 2.0**64, strict=True))
    return [d if d < 1 << 63 else None for d in exact]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each vector length."""
    sums = sums_of(vectors)
    out = {}
    for width, v in covariances(vectors, sums).items():
        values, x = eigenpairs(v, components)
        out[width] = Whitening(*sums[width], values, x, float(np.trace(v)))
    return out


def identity_errors(vectors: DataFrame, model: dict[int, Whitening]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, by vector length.

    Each task centres its own vectors on their own mean; the means of the tasks make up the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for _, x in whole_vectors(b):
                w = model[x.shape[1]].of(model[x.shape[1]].centred(x))
                n, mean = len(w), w.mean(0)
                products = (w - mean).T @ (w - mean)
                if x.shape[1] in held:
                    m, old, sofar = held[x.shape[1]]
                    gap = mean - old
                    products += sofar + np.outer(gap, gap) * (n * m / (n + m))
                    mean = old + gap * (n / (n + m))
                    n += m
                held[x.shape[1]] = [n, mean, products]
        for width, (n, mean, products) in held.items():
            k = len(mean)
            i, j = (m.ravel() for m in np.indices((k, k)))
            columns = [np.full(k * k, width, np.int32), i.astype(np.int32), j.astype(np.int32), products.ravel(), n * mean[i], n * mean[i] * mean[j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["width", "i", "j", "products", "sums", "squares"])

    parts = doubles(vectors).mapInArrow(run, "width int, i int, j int, products double, sums double, squares double")
    found = parts.groupBy("width", "i", "j").agg(F.sum("products").alias("p"), F.sum("sums").alias("s"), F.sum("squares").alias("q")).collect()
    means = {(r["width"], r["i"]): r["s"] / model[r["width"]].n for r in found}
    out: dict[int, float] = {}
    for r in found:
        n = model[r["width"]].n
        entry = (r["p"] + r["q"]) / n - means[r["width"], r["i"]] * means[r["width"], r["j"]]
        out[r["width"]] = max(out.get(r["width"], 0.0), abs(entry - (r["i"] == r["j"])))
    return out


def whiten(vectors: DataFrame, model: dict[int, Whitening], errors: dict[int, float] | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component."""
    errors = identity_errors(vectors, model) if errors is None else errors
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, x in whole_vectors(b):
                m = model[x.shape[1]]
                k = len(m.values)
                centred = m.centred(x)
                out = np.full((len(x), k), np.nan)
                out[:, m.values > 0] = m.of(centred)
                rows = np.repeat(np.arange(len(x)), k)
                explained = np.tile(m.values / m.trace if m.trace else np.full(k, np.nan), len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(pa.array(places[rows])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), m.n)),
                        pa.array(deviations(centred), pa.int64()).take(pa.array(rows)),
                        pa.array(out.ravel(), from_pandas=True),
                        pa.array(explained, from_pandas=True),
                        pa.array([errors.get(x.shape[1])] * len(rows), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return doubles(vectors).mapInArrow(run, shape)
