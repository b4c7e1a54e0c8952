"""Embedding whitening by spectrum slicing.

How many eigenvalues of a symmetric matrix lie below a number s is the count of negative pivots in an LDL' factorisation
of the matrix less s on its diagonal. Halving by these counts isolates each of the leading eigenvalues; from there Rayleigh
quotient iteration converges at the third order. Counts on either side of what it found certify the number that the
eigenvalue has from the top; where they don't, its interval is halved on. Eigenvalues that no halving can tell apart are
taken as a cluster: its whole subspace is iterated, and sliced in turn for what differences are left; beyond them any
basis is right.

Vectors are made whole numbers x = floor(scale * c) + shift. The fit list holds each distinct x once. Tasks sum its rows,
then products of its centred rows; rows of the matrix meet by their number, and the driver holds the one matrix, of the
dimension squared. Centring takes off the whole part of the mean, exactly, and then its fraction.

Null vectors and those with null, NaN or infinite entries are dropped, and those whose length is not the commonest one
(of equals the longest), which is the dimension; so are empty vectors. Repeated rows and ids are rows. Components whose
eigenvalue is no more than RANK of the largest cannot be scaled and are left out, so that one distinct vector, or none,
gives no rows, and so does an empty table. Other columns are not read, whatever their names. Entries beyond 2**53 / scale
are refused by Spark's own overflow checks, deviations beyond 63 bits by an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, trimmed

SCALE, SHIFT = 64, 1_000_000
MOST = 16
#: Eigenvalues of no more than this share of the largest one count as zero.
RANK = 1e-12
#: Eigenvalues nearer to each other than this share of the largest one are a cluster.
NEAR = 1e-9
#: Vectors that a task handles at a time.
BATCH = 4096


def ldl_signs(a: np.ndarray) -> tuple[int, int]:
    """Numbers of negative and of zero pivots in the LDL' factorisation of a symmetric matrix: by Sylvester's law, of its
    negative and zero eigenvalues. Pivots are of one or two rows (diagonal pivoting by Bunch and Kaufman), so that growth
    is bounded whatever the signs."""
    a, n, k, below, zero = np.array(a, float), len(a), 0, 0, 0
    bound = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(np.argmax(column)) if k + 1 < n else k
        most = column[r - k - 1] if k + 1 < n else 0.0
        size = 1
        if max(abs(a[k, k]), most) == 0.0:
            zero += 1
            k += 1
            continue
        if abs(a[k, k]) < bound * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            other = row.max()
            if abs(a[k, k]) * other < bound * most * most:
                if abs(a[r, r]) >= bound * other:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        d, c = a[k : k + size, k : k + size], a[k + size :, k : k + size].copy()
        if size == 1:
            below += d[0, 0] < 0
            a[k + 1 :, k + 1 :] -= np.outer(c[:, 0] / d[0, 0], c[:, 0])
        else:  # a pair of rows has one eigenvalue of either sign
            below += 1
            a[k + 2 :, k + 2 :] -= np.linalg.solve(d, c.T).T @ c.T
        k += size
    return int(below), zero


class Spectrum:
    """Counts of a matrix's eigenvalues above a number, each worked out once."""

    def __init__(self, v: np.ndarray) -> None:
        self.v, self._known = v, {}

    def above(self, s: float) -> int:
        if s not in self._known:
            below, zero = ldl_signs(self.v - s * np.eye(len(self.v)))
            self._known[s] = len(self.v) - below - zero
        return self._known[s]


def isolated(spectrum: Spectrum, most: int, low: float, high: float, near: float) -> list[tuple[float, float, int]]:
    """Intervals (a, b, m), from the top, that hold m eigenvalues together: one, or more of them where the interval is no
    wider than `near`. They cover the `most` leading eigenvalues in (low, high]."""
    out, open_ = [], [(low, high, spectrum.above(low), spectrum.above(high))]
    while open_ and sum(m for *_, m in out) < most:
        a, b, na, nb = open_.pop()
        if na == nb:
            continue
        if na - nb == 1 or b - a <= near:
            out.append((a, b, na - nb))
            continue
        c = (a + b) / 2
        nc = spectrum.above(c)
        open_ += [(a, c, na, nc), (c, b, nc, nb)]  # the upper half comes next
    return out


def _solved(v: np.ndarray, shift: float, x: np.ndarray, tiny: float) -> np.ndarray:
    """(v - shift) ** -1 x. A shift that is an eigenvalue, as far as numbers tell, is moved by a hair."""
    for move in (0.0, tiny, 4 * tiny):
        try:
            y = np.linalg.solve(v - (shift + move) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    raise ArithmeticError("no inverse near an eigenvalue")


def _free(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """Columns of x made orthonormal, and orthogonal to the basis; twice, as once may not be enough."""
    x = x.copy()
    for _ in range(2):
        for j in range(x.shape[1]):
            for b in [*basis, *x.T[:j]]:
                x[:, j] -= b * (b @ x[:, j])
            x[:, j] /= np.linalg.norm(x[:, j])
    return x


def rayleigh(v: np.ndarray, a: float, b: float, start: np.ndarray, tiny: float, most: int = 30) -> tuple[float, np.ndarray]:
    """An eigenvalue and its vector, sought in (a, b): one step of inverse iteration from its middle, then each shift is
    the Rayleigh quotient of the vector so far."""
    x = _solved(v, (a + b) / 2, start / np.linalg.norm(start), tiny)
    x /= np.linalg.norm(x)
    best, idle = (np.inf, 0.0, x), 0
    for _ in range(most):
        shift = float(x @ v @ x)
        left = float(np.linalg.norm(v @ x - shift * x))  # never grows, but for rounding
        idle = idle + 1 if left > 0.9 * best[0] and left < 1e-6 * abs(b) else 0
        best = min(best, (left, shift, x), key=lambda r: r[0])
        if idle == 2 or left <= tiny:
            break
        x = _solved(v, shift, x, tiny)
        x /= np.linalg.norm(x)
    return best[1], best[2]


def leading(v: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit vectors as columns."""
    d = len(v)
    radius = float(np.abs(v).sum(1).max()) if d else 0.0  # no eigenvalue is larger
    if not radius:
        return np.zeros(0), np.zeros((d, 0))
    spectrum, rng = Spectrum(v), np.random.default_rng(1)
    tiny = radius * np.finfo(float).eps
    top = isolated(spectrum, 1, 0.0, radius * (1 + 1e-9), NEAR * radius)
    high = top[0][1] if top else 0.0
    values: list[float] = []
    basis: list[np.ndarray] = []
    for a, b, m in isolated(spectrum, min(most, d), RANK * high, radius * (1 + 1e-9), NEAR * high):
        number = spectrum.above(b)  # so many lie above the interval
        if m == 1:
            while True:
                value, x = rayleigh(v, a, b, rng.normal(size=d), tiny)
                exact = 8 * d * tiny
                edge = max(2 * float(np.linalg.norm(v @ x - value * x)), exact)
                if spectrum.above(value + edge) == number and spectrum.above(value - edge) == number + 1:
                    break  # certified: eigenvalue `number` + 1 from the top
                if b - a <= 2 * exact:  # as narrow as numbers tell eigenvalues apart
                    break
                c = (a + b) / 2
                a, b = (c, b) if spectrum.above(c) > number else (a, c)
            x = _free(x[:, None], basis)
        else:
            x = _free(rng.normal(size=(d, m)), basis)
            for _ in range(6):
                x = _free(_solved(v, b + (b - a), x, tiny), basis)
            inner = x.T @ (v @ x) - (a + b) / 2 * np.eye(m)  # what is left of their differences
            spread = float(np.abs(inner).sum(1).max())
            if spread > 64 * d * tiny:
                x = x @ leading((inner + inner.T) / 2 + 2 * spread * np.eye(m), m)[1]
        for y in x.T:
            basis.append(y)
            values.append(float(y @ v @ y))
    order = sorted(range(len(values)), key=lambda k: (-values[k], k))[:most]
    vectors = np.array([basis[k] for k in order]).reshape(len(order), d).T
    for y in vectors.T:  # the largest entry of each is positive
        y *= 1.0 if y[np.argmax(np.abs(y))] > 0 else -1.0
    return np.array([values[k] for k in order]), vectors


@dataclass(frozen=True)
class Fit:
    """Whitening of a fit list: its rows, sums by dimension, the leading eigenvalues with their vectors, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - np.array([(s % self.n) / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """sum((n * x - sums) ** 2) for each row, exactly."""
        off = x - self.base
        rest = np.array([s % self.n for s in self.sums], np.int64)
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most < 1 << 62 and most * most * max(1, x.shape[1]) < 1 << 63:
            y = off * self.n - rest
            return (y * y).sum(1)
        out = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, rest)) for row in off]
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation does not fit 63 bits")
        return np.array(out, np.int64)


def whole(df: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """df's rows that remain, with x as an array of whole numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    out = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn("x", F.transform(vector, lambda c: c.cast("double")))
    out = out.filter(~F.exists("x", bad)).withColumn("x", F.transform("x", lambda c: F.floor(c * scale).cast("long") + shift)).drop(vector)
    lengths = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return out.filter(F.size("x") == (lengths[0].d if lengths else 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _summed(df: DataFrame, use, kind: str) -> dict[int, np.ndarray]:
    """Rows of numbers by name that `use` makes of the vectors of a task, added over all tasks: first within a task, then
    by name. A result is a row of numbers for each name: the dimension at most."""

    def added(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, v in of(batch):
                total[name] = total[name] + v if name in total else v
        if total:
            yield pa.RecordBatch.from_pydict({"name": list(total), "v": list(total.values())}, schema=pa.schema([("name", pa.int32()), ("v", pa.list_(pa.int64() if kind == "bigint" else pa.float64()))]))

    def first(batch: pa.RecordBatch):
        for j in range(0, batch.num_rows, BATCH):
            yield from enumerate(np.atleast_2d(use(matrix(batch.column(0).slice(j, BATCH)))))

    def again(batch: pa.RecordBatch):
        yield from zip(batch.column(0).to_pylist(), (np.array(v.values) for v in batch.column(1)))

    schema = f"name int, v array<{kind}>"
    each = df.select("x").mapInArrow(trimmed(lambda b: added(b, first)), schema)
    total = each.repartition("name").mapInArrow(trimmed(lambda b: added(b, again)), schema)
    return {r.name: np.array(r.v) for r in total.collect()}


def _products(df: DataFrame, use) -> np.ndarray:
    """Sums over all rows y that use makes of vectors: y as the first row, y'y as the others."""

    def both(x: np.ndarray) -> np.ndarray:
        y = use(x)
        return np.concatenate([y.sum(0)[None], y.T @ y])

    got = _summed(df, both, "double")
    return np.array([got[k] for k in sorted(got)])


def fit(rows: DataFrame, most: int = MOST) -> tuple[Fit | None, DataFrame]:
    """The whitening of the distinct vectors x of rows, and the table of them; None where there are none."""
    distinct = materialise(rows.select("x").distinct(), "distinct")
    got = _summed(distinct, lambda x: np.concatenate([x.sum(0), [len(x)]]), "bigint")
    if not got:
        return None, distinct
    *sums, n = (int(s) for s in got[0])
    d = len(sums)
    start = Fit(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    found = _products(distinct, start.centred)
    mean = found[0] / n  # nothing but rounding
    v = found[1:] / n - np.outer(mean, mean)
    v = (v + v.T) / 2
    values, vectors = leading(v, most)
    return Fit(n, sums, values, vectors, float(np.trace(v))), distinct


def identity_error(fit_: Fit, distinct: DataFrame) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    found = _products(distinct, fit_.whitened)
    mean = found[0] / fit_.n
    return float(np.abs(found[1:] / fit_.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """key, whitened (array, a number for each component) and deviation of each remaining row, with n, explained (array)
    and identity_error of the fit."""
    rows = whole(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", scale, shift)
    kind = dict(rows.dtypes)["key"]
    schema = f"`{key}` {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    fit_, distinct = fit(rows, most)
    if fit_ is None or not len(fit_.values):
        return df.sparkSession.createDataFrame([], schema)
    error, share = identity_error(fit_, distinct), (fit_.values / fit_.trace).tolist()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, BATCH):
                part = batch.slice(j, BATCH)
                x = matrix(part.column(1))
                w, count = fit_.whitened(x), len(x)
                ends = pa.array(np.arange(count + 1, dtype=np.int32) * w.shape[1])
                arrays = [part.column(0), pa.array([fit_.n] * count, pa.int64()), pa.array(fit_.deviation(x)), pa.ListArray.from_arrays(ends, pa.array(w.ravel())), pa.array([share] * count, pa.list_(pa.float64())), pa.array([error] * count, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [key, "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("key", "x").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "p")
    out = out.select("vec_id", "n", "deviation", "identity_error", each)
    return out.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("p.whitened").alias("whitened"), F.col("p.explained").alias("explained"), "identity_error")
