"""Mined negatives against all scores in plain whole numbers; bounds against the scores they enclose."""

import math
import random

import numpy as np
import pytest

from echofold.llm import hard_negatives as hn


def frame(spark, rows):
    full = [(i, v, k, "x", 1, 2, 3.0) for i, v, k in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, x string, part int, no int, angle double").repartition(3)


def brute(rows, every=100, top=5, scale=256):
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    ok = {(i, k, tuple(math.floor(scale * c) for c in v)) for i, v, k in rows
          if i is not None and k is not None and v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, k, x in ok:
        if i % every:
            continue
        score = {(sum(a * b for a, b in zip(x, y, strict=True)), j, m == k) for j, m, y in ok if j != i}
        mine = sorted(((s, j) for s, j, same in score if same), key=lambda e: (-e[0], e[1]))[:top]
        for s, j in mine:
            far = sorted(((t, n) for t, n, same in score if not same and 80 * s <= 100 * t <= 100 * s), key=lambda e: (-e[0], e[1]))[:top]
            out += [(i, j, r, n, s, t) for r, (t, n) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    got = hn.hard_negatives(frame(spark, rows), **kw)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def cloud(seed, n, dim=12, labels=4, spread=0.6, first=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(8, dim))
    return [(first + i, [float(c) for c in centre[r.integers(8)] + spread * r.normal(size=dim)], int(r.integers(labels))) for i in range(n)]


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Sizes at which a few hundred rows need several windows, parts, blocks and slices."""
    for name, v in (("WINDOW", 16), ("PART_ROWS", 150), ("BLOCK", 7), ("SLICES", 3), ("HELD", 40), ("SAMPLE", 200)):
        monkeypatch.setattr(hn, name, v)


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_equals_all_scores(spark, spread):
    rows = cloud(3, 900, spread=spread)
    want = brute(rows, every=20)
    assert want and mined(spark, rows, every=20) == want


def test_ties_copies_and_a_vector_of_a_third_of_all_rows(spark):
    rows = cloud(4, 300, spread=0.3)
    rows += [(1000 + i, rows[100][1], (rows[100][2] + i) % 4) for i in range(200)]
    rows += [(5000 - i, rows[200][1], rows[200][2]) for i in range(30)] + rows[:60] + rows[95:105]
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_odd_rows(spark):
    rows = cloud(5, 300, dim=3, labels=2)
    odd = [(None, [1.0, 2.0, 3.0], 1), (7001, None, 1), (7002, [1.0, None, 2.0], 0), (7003, [float("nan"), 0.0, 0.0], 0), (7004, [0.0, float("inf"), 0.0], 1), (7005, [1.0, 2.0], 1),
           (7006, [], 0), (7007, [1.0, 2.0, 3.0], None), (7100, [0.0, 0.0, 0.0], 1), (7101, [0.0, 0.0, 0.0], 0), (-100, [1.0, 1.0, 1.0], 0), (200, [9.0, 1.0, -1.0], 1), (200, rows[200][1], 1 - rows[200][2])]
    assert mined(spark, rows + odd) == brute(rows + odd)
    assert mined(spark, [*rows, (8000, [1e30, 0.0, 0.0], 0)]) == brute(rows)          # beyond what whole scores can hold


def test_few_rows_and_none(spark):
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []                          # no anchor
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == brute([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) != []
    assert hn.hard_negatives(frame(spark, [(0, [1.0], 1)]).where("1 = 0")).count() == 0


def test_scores_beyond_floats_are_exact(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) * 8e5 for _ in range(6)], i % 2) for i in range(120)]
    want = brute(rows, every=10)
    assert max(abs(e[4]) for e in want) > 2**53 and mined(spark, rows, every=10) == want


def test_bounds_enclose_every_score(rng):
    for dim, k in ((2, 1), (5, 3), (16, 16), (4, 0)):
        x = np.floor(256 * rng.normal(size=(400, dim))).astype(int)
        x[:5] = 0
        x[5:20] = x[20] * np.arange(15)[:, None]
        refs = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:k]
        norm, t = hn.angles(x, refs)
        for at in np.split(rng.permutation(400), 40):
            low, high = hn.score_bounds(norm, t, (norm[at].min(), norm[at].max()), (t[at].min(axis=0), t[at].max(axis=0)))
            s = x @ x[at].T
            assert (s >= low[:, None]).all() and (s <= high[:, None]).all()


def test_windows_out_of_reach_are_not_scored(spark, monkeypatch):
    """Close groups: nearly all windows are left out by their bounds alone."""
    rows = cloud(6, 1500, dim=6, spread=0.01)
    _, refs = np.eye(6), np.eye(6)
    x = np.floor(256 * np.array([v for _, v, _ in rows])).astype("<i4")
    norm, t = hn.angles(x, refs)
    order = np.lexsort((t.min(axis=1), t.argmin(axis=1)))
    scored = total = 0
    for at in np.array_split(order, 94):
        low, high = hn.score_bounds(norm[:200], t[:200], (norm[at].min(), norm[at].max()), (t[at].min(axis=0), t[at].max(axis=0)))
        scored, total = scored + (high >= 0.99 * norm[:200] ** 2).sum(), total + 200
    assert scored < 0.5 * total
