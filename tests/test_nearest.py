"""Searches in the tree of cells against all distances."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echofold.operators import matching, nearest


def project(points, tracks):
    """Nearest vertex of each line, the better of its two segments, the better line."""
    out = {}
    for site, px, py in points:
        best = None
        for line, rows in tracks.items():
            d = [math.hypot(x - px, y - py) for _, x, y, _ in rows]
            k = min(range(len(rows)), key=lambda i: (d[i], rows[i][0]))
            _, x, y, al = rows[k]
            for o in (k - 1, k + 1):
                if not 0 <= o < len(rows):
                    continue
                vx, vy = rows[o][1] - x, rows[o][2] - y
                if vx == vy == 0:
                    continue
                t = max(0.0, min(1.0, ((px - x) * vx + (py - y) * vy) / (vx * vx + vy * vy)))
                c = (math.hypot(x + t * vx - px, y + t * vy - py), line, al + t * (rows[o][3] - al))
                best = c if best is None or c < best else best
        out[site] = best
    return out


@pytest.mark.parametrize("cap", [4, 64])
def test_projection_equals_all_distances(spark, monkeypatch, cap):
    monkeypatch.setattr(nearest.cell_tree, "__defaults__", ((), None, cap))
    r = random.Random(4)
    tracks = {}
    for line in range(6):
        x, y, h, rows = r.uniform(0, 1e4), r.uniform(0, 1e4), r.uniform(0, 6), []
        for c in range(300 if line else 40):
            h += r.gauss(0, 0.2)
            step = r.choice([3, 5, 9]) if line != 3 or c % 50 else 4000.0          # line 3 has long gaps
            x, y = x + step * math.cos(h), y + step * math.sin(h)
            rows.append((c, x, y, c * 2.5))
        tracks[line] = rows
    points = [(f"s{k}", r.uniform(-2e3, 1.2e4), r.uniform(-2e3, 1.2e4)) for k in range(60)] + [("far", 9e7, -4e7), ("near", tracks[2][10][1] + 0.4, tracks[2][10][2]), ("on", tracks[5][7][1], tracks[5][7][2])]
    tr = spark.createDataFrame([(i, *v) for i, rows in tracks.items() for v in rows] + [(9, 1, None, 2.0, 0.0)], "line_id long, col int, x double, y double, along_m double")
    pts = spark.createDataFrame([*points, ("none", None, 1.0), points[0]], "site string, x double, y double")
    got = {v.site: (v.off_m, v.line_id, v.along_m) for v in matching.project_on_track(pts, tr).collect()}
    want = project(points, tracks)
    assert set(got) == set(want)
    for site, (off, line, along) in want.items():
        assert got[site][1] == line and math.isclose(got[site][0], off, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[site][2], along, rel_tol=1e-6, abs_tol=1e-5), site
    assert matching.project_on_track(pts, tr.where("1 = 0")).count() == 0


def test_crowded_cells_give_the_same_matches(spark, rng):
    n = 700
    a = pd.DataFrame({"line_id": np.arange(n) % 2, "block": np.arange(n), "x": rng.normal(size=n) * 3, "y": rng.normal(size=n) * 3})
    b = pd.DataFrame({"line_id": np.arange(n) % 2, "other": np.arange(n) + 5000, "x": np.where(np.arange(n) % 5 == 0, 1e4, 1) * rng.normal(size=n), "y": rng.normal(size=n).round(1)})
    b.loc[:40, ["x", "y"]] = 0.5
    da, db = spark.createDataFrame(a), spark.createDataFrame(b)
    got, plain = (matching.nearest_match_xy(da, db, 2.0, "block", "other", by=["line_id"], crowd=c).toPandas().sort_values("block").reset_index(drop=True) for c in (10, 10**6))
    pd.testing.assert_frame_equal(got, plain)
    want = {}
    for line in (0, 1):
        p, q = a[a.line_id == line], b[b.line_id == line]
        d = np.hypot(p.x.to_numpy()[:, None] - q.x.to_numpy(), p.y.to_numpy()[:, None] - q.y.to_numpy())
        want |= {i: min(zip(row, q.other)) for i, row in zip(p.block, d) if row.min() <= 2}
    assert {r.block: r.other for r in got.itertuples()} == {i: o for i, (_, o) in want.items()}


def test_a_million_positions_in_one_cell(spark):
    at = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**9)) / 1e9)
    b = spark.range(1_000_000).select(F.col("id").alias("other"), at(1).alias("x"), at(2).alias("y"))
    a = spark.range(2000).select(F.col("id").alias("block"), at(3).alias("x"), at(4).alias("y"))
    got = matching.nearest_match_xy(a, b, 10.0, "block", "other").toPandas()
    assert len(got) == 2000 and got.gap.max() < 0.01 and abs(got.gap.mean() - 0.5e-3) < 5e-5           # half of 1 / sqrt(density)


def test_nearest_other_of_a_long_line(spark, rng):
    p = pd.DataFrame({"line_id": 0, "block": np.arange(1500), "x": rng.normal(size=1500), "y": rng.normal(size=1500)})
    p.loc[20, ["x", "y"]] = p.loc[10, ["x", "y"]]
    p = pd.concat([p, pd.DataFrame({"line_id": [1, 1, 2], "block": [1, 2, 1], "x": [0.0, 3.0, 5.0], "y": [0.0, 4.0, 5.0]})])
    got = matching.nearest_other(spark.createDataFrame(p)).toPandas().set_index(["line_id", "block"])
    q = p[p.line_id == 0]
    d = np.hypot(q.x.to_numpy()[:, None] - q.x.to_numpy(), q.y.to_numpy()[:, None] - q.y.to_numpy())
    np.fill_diagonal(d, np.inf)
    j = d.argmin(axis=1)
    ok = d.min(axis=1) > 0
    assert sorted(got.loc[0].index) == sorted(q.block[ok])
    want = np.c_[q.x.to_numpy()[j] - q.x, q.y.to_numpy()[j] - q.y][ok] / d.min(axis=1)[ok][:, None]
    np.testing.assert_allclose(got.loc[0].sort_index()[["ux", "uy"]], want, atol=1e-9)
    np.testing.assert_allclose(got.loc[1, 1], [0.6, 0.8])
    assert (2, 1) not in got.index


def test_a_response_that_falls_seaward_is_refused(spark):
    rows = [(1, k, 100.0 * k, 80.0 - 0.01 * k, 0.1 * k) for k in range(6)] + [(2, k, 100.0 * k, 70.0 + 0.01 * k, -0.1 * k) for k in range(6)]
    df = spark.createDataFrame(rows, "line int, block int, xb double, lat double, a double")
    got = matching.orient_seaward(df, ["line"]).toPandas()
    assert (got.r_sea > 0.99).all() and got[got.line == 2].sort_values("block").x_sea.tolist() == [500.0, 400.0, 300.0, 200.0, 100.0, 0.0]
    wrong = df.withColumn("a", F.when(F.col("line") == 1, -F.col("a")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="falls seaward"):
        matching.orient_seaward(wrong, ["line"]).collect()
    assert matching.orient_seaward(wrong, ["line"], strict=False).where("r_sea < 0").count() == 6
