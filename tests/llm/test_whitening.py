"""Whitening against numpy's solver, and the eigenvalue counts against known spectra."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hicweave.llm import whitening
from hicweave.llm.common import table

D = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows):
    """(vec_id, vector) -> rows that remain, whole vectors, n, sums, falling eigenvalues, vectors, trace; by numpy."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in kept if len(v) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[x - s / n for x, s in zip(row, sums)] for row in fit]).reshape(n, d)
    v = centred.T @ centred / max(1, n)
    e, q = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
    return kept, n, sums, e[::-1], q[:, ::-1], float(np.trace(v))


def check(got: pd.DataFrame, rows, most=16):
    kept, n, sums, e, q, trace = brute(rows)
    k = min(most, int((e > 1e-12 * e.max(initial=0)).sum())) if n > 1 else 0
    assert len(got) == k * len(kept)
    if not k:
        return
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] <= 1e-4
    assert np.allclose(sorted(got.groupby("component").explained.first(), reverse=True), e[:k] / trace, rtol=1e-9)
    want = sorted((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept)
    assert sorted(zip(got[got.component == 1].vec_id, got[got.component == 1].deviation)) == want
    simple = [c for c in range(k) if all(abs(e[c] - e[o]) > 1e-6 * e[0] for o in (c - 1, c + 1) if 0 <= o < len(e))]
    for c in simple:
        part = got[got.component == c + 1].groupby("vec_id").whitened.first()
        mine = {i: sum((a - s / n) * b for a, s, b in zip(x, sums, q[:, c])) / math.sqrt(e[c]) for i, x in kept}
        sign = math.copysign(1, part[max(mine, key=lambda i: abs(mine[i]))] * max(mine.values(), key=abs))
        assert all(abs(part[i] - sign * mine[i]) < 1e-6 * max(1, abs(mine[i])) for i in mine)


def test_registered_query(spark):
    from hicweave.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in table(spark, D, "embeddings").select("vec_id", "embedding").collect()]
    got = QUERIES["op11_embedding_whitening"](spark, D)
    assert got.columns == COLUMNS and dict(got.dtypes) == dict(zip(COLUMNS, ("bigint", "int", "bigint", "bigint", "double", "double", "double")))
    check(got.toPandas(), rows)


def whitened(df, **more):
    out = whitening.whiten(df, **more)
    out = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "p"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "p.whitened", "p.explained", "identity_error").toPandas()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("mine") for c in ("x", "n", "key", "whitened", "deviation")}).repartition(5)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=6)]) for k in range(80)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (105, [-float("inf")] + [0.0] * 5), (106, [1.0] * 5), (107, [1.0] * 7)]
    rows += [rows[0]] * 40 + [(200, rows[1][1])]  # repeated rows count once in the fit
    check(whitened(frame(spark, [*rows, (300, rows[2][1])])), [*rows, (300, rows[2][1])])
    check(whitened(frame(spark, rows), most=3), rows, most=3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 9, [(1, [0.5]), (2, [1.5])]])
def test_few_vectors(spark, rows):
    check(whitened(frame(spark, rows)), rows)


def test_rank_and_ties(spark):
    """Fewer directions than dimensions; equal eigenvalues, of which any basis is right."""
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(20)]
    check(whitened(frame(spark, line)), line)
    square = [(k, [float(a), float(b), 9.0]) for k, (a, b) in enumerate([(0, 0), (0, 4), (4, 0), (4, 4)])]
    got = whitened(frame(spark, square))
    check(got, square)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(w.T @ w / 4, np.eye(2), atol=1e-12)


@pytest.mark.parametrize("n", range(1, 12))
def test_counts_of_signs(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = rng.integers(-3, 4, (n, n)).astype(float) * (rng.random((n, n)) < 0.6)
        a += a.T
        e = np.linalg.eigvalsh(a)
        below, zero = whitening.ldl_signs(a)
        if np.abs(e).min() > 1e-9:
            assert (below, zero) == ((e < 0).sum(), 0)
    assert whitening.ldl_signs(np.zeros((n, n))) == (0, n)


@pytest.mark.parametrize("values", [[3.0] * 5, [5, 5, 2, 2, 1], [1, 1 - 1e-10, 1 - 1e-8, 1 - 1e-6, 0.5, 0.5 + 1e-13, 0.1], [1, 1e-5, 1e-9], [7.0], list(np.linspace(1, 2, 40))])
def test_leading_eigenvalues(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.leading(v, 16)
    want = np.sort(values)[::-1][:16]
    assert np.abs(e - want).max() < 1e-14 * d * want[0] * 4
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-13 and np.abs(v @ x - x * e).max() < 1e-13 * d * want[0]


def test_deviations_are_exact():
    rows = np.array([[3_900_000, 999_000], [3, 1_000_000]])
    f = whitening.Fit(1000, [1_000_000_123, 999_999_877], np.zeros(0), np.zeros((2, 0)), 0.0)
    assert f.deviation(rows).tolist() == [sum((1000 * int(a) - s) ** 2 for a, s in zip(r, f.sums)) for r in rows]
    with pytest.raises(OverflowError):
        whitening.Fit(10**9, [0, 0], np.zeros(0), np.zeros((2, 0)), 0.0).deviation(rows)
