"""Whitening against a plain computation in whole numbers and one dense eigendecomposition."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

from echofold.llm import catalog, whitening

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    full = [(i, v, 3, "w", 1.5) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, w string, x double").repartition(3)


def brute(rows, weights="count"):
    """Per row (vec_id, deviation, coordinates up to sign), eigenvalues and trace."""
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    ok = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows
          if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in ok] if weights == "count" else [list(t) for t in {tuple(x) for _, x in ok}]
    n = len(fit)
    total = [sum(c) for c in zip(*fit, strict=True)]
    d = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, total, strict=True)] for x in fit])
    cov = d.T @ d / n
    value, vec = np.linalg.eigh(cov)
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)),
            np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, total, strict=True)]) @ vec[:, ::-1]) for i, x in ok]
    return n, out, value[::-1], cov.trace()


def same(got, rows, weights="count"):
    n, want, value, trace = brute(rows, weights)
    got = got.sort_values(["vec_id", "deviation"]).reset_index(drop=True)
    want = sorted(want, key=lambda r: (r[0], str(r[1])))
    assert list(got.vec_id) == [r[0] for r in want] and set(got.n) == {n}
    assert [int(v) for v in got.deviation] == [r[1] for r in want]
    k = min(8, len(value))
    coord = np.array([r[2][:k] for r in want]) / np.sqrt(value[:k])
    mine = np.array(got.whitened.tolist(), float)
    sign = np.sign((coord * mine).sum(axis=0))
    np.testing.assert_allclose(mine * sign, coord, rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(got.explained.iloc[0], value[:k] / trace, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize("weights", ["count", "one"])
def test_query_rows_equal_plain_sums(spark, weights):
    t = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").df()
    rows = list(zip(t.vec_id, [list(v) for v in t.embedding], strict=True))
    rows += [(i + 10_000, v) for i, v in rows[:40]] + [(i + 20_000, rows[7][1]) for i in range(150)]       # copies, one vector often
    same(whitening.whiten(frame(spark, [(int(i), [float(c) for c in v]) for i, v in rows]), weights=weights).toPandas(), rows, weights)


def test_registered_query(spark):
    got = catalog.QUERIES["op13_whitening"](spark, SF).toPandas()
    t = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").df()
    rows = list(zip(t.vec_id, [list(v) for v in t.embedding], strict=True))
    assert len(got) == 8 * len(rows) and sorted(got.component.unique()) == list(range(1, 9))
    wide = got.sort_values("component").groupby("vec_id").agg(
        n=("n", "first"), deviation=("deviation", "first"), whitened=("whitened", list), explained=("explained", list), identity_error=("identity_error", "first")).reset_index()
    same(wide, rows)


def test_odd_rows(spark, rng):
    v = lambda: [float(c) for c in rng.normal(size=3)]
    good = [(i, v()) for i in range(1, 12)]
    rows = good + [(1, good[0][1]), (50, good[1][1]), (12, None), (13, [1.0, None, 2.0]), (14, [1.0, float("nan"), 2.0]), (15, [float("inf"), 0.0, 0.0]), (16, [1.0, 2.0]), (17, []),
                   (18, [1e30, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    same(got, [r for r in rows if r[0] != 18])
    assert whitening.whiten(frame(spark, [(None, v()), (3, v()), (3, v())])).filter("vec_id is null").count() == 1


def test_values_beyond_doubles_stay_exact(spark):
    rows = [(i, [1e9 * (1 + i % 3), float(i), -5e8]) for i in range(30)]
    got = whitening.whiten(frame(spark, rows)).toPandas().set_index("vec_id")
    assert {i: int(d) for i, d in got.deviation.items()} == {r[0]: r[1] for r in brute(rows)[1]}
    assert got.whitened.map(lambda w: w[2] is None or np.isnan(w[2])).all()                 # the third direction has no variance


def test_without_rows_or_variance(spark):
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, []).where("1 = 0")).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).toPandas()
    assert len(one) == 2 and all(pd.isna(c) for w in one.whitened for c in w) and set(one.deviation) == {"0"}
