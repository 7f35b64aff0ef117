"""Tiled scans against plain windows and numpy, with one group holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echofold.operators import firn, interp, matching, profiles, quantiles, scan, unwrap
from echofold.operators.scan import Scan

KINDS = ["sum", "max", "min", "last", "next", "prev", "follow", "past", "ahead"]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 1500
    g = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 12, n))
    # Positions bunched up near zero with a far outlier.
    x = np.exp(rng.normal(size=n) * 3) + np.arange(n) * 1e-6
    v = rng.normal(size=n).round(2)
    p = pd.DataFrame({"g": g, "x": x, "v": v, "id": np.arange(n)})
    df = spark.createDataFrame(p).withColumn("v", F.when(F.col("id") % 7 != 3, F.col("v")))
    p.loc[p.id % 7 == 3, "v"] = np.nan
    return df, p


def test_tiles_stay_small(skewed):
    df, _ = skewed
    big = scan.tile(df, "g", "x", rows=100).groupBy("g", scan.TILE).count().agg(F.max("count")).first()[0]
    assert big <= 120 and df.where("g = 0").count() == 500


def test_cuts_of_a_sample_hold_for_a_large_group(spark):
    """200,000 rows of one group and a place that a third of them share: tiles near half of `rows`, in order, none empty."""
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.rand(3) * 100).alias("x"), "id").unionByName(
        spark.range(300).select(F.lit("b").alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") + 10**6).alias("id")))
    df = df.repartition(6)
    t = scan.tile(df, "g", ["x", "id"], 5000).groupBy("g", scan.TILE).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "id")).alias("lo"), F.max(F.struct("x", "id")).alias("hi")).toPandas().sort_values(["g", scan.TILE])
    a = t[t.g == "a"].reset_index(drop=True)
    assert list(a[scan.TILE]) == list(range(len(a))) and 70 <= len(a) <= 80 and a.n.max() <= 5000 and list(t[t.g == "b"].n) == [300]
    assert all(tuple(p) < tuple(q) for p, q in zip(a.hi[:-1], a.lo[1:], strict=True))


def test_plan_has_one_exchange_of_the_payload_and_no_checkpoint_of_it(skewed):
    df, _ = skewed
    wide = df.withColumn("payload", F.lit("x" * 10))
    text = scan.scan(wide, "g", ["x", "id"], [Scan("s", F.col("v"), "sum"), Scan("l", F.col("v"), "last")], rows=60)._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    scans = [k for k, line in enumerate(lines) if "Scan ExistingRDD" in line]
    assert len([k for k in lines if "Exchange hashpartitioning(g" in k and "_tile" in k]) <= 3 and len(scans) == 4          # rows and totals, each with the cuts


def test_tiled_scan_equals_window(skewed):
    df, _ = skewed
    specs = [Scan(k, F.col("v"), k) for k in KINDS]
    a = scan.scan(df, "g", ["x", "id"], specs, rows=60).toPandas().sort_values("id")
    b = scan.ordered(df, "g", ["x", "id"], specs, True).toPandas().sort_values("id")
    for k in KINDS:
        np.testing.assert_allclose(a[k].astype(float), b[k].astype(float), atol=1e-9, err_msg=k)


def test_null_keys_null_orders_text_orders_and_hot_positions(spark):
    """Tiled and plain agree for a NULL group, NULL places, text as the order, and a place that holds many rows."""
    rows = [(None if i < 150 else "a" if i < 300 else "b", None if i % 37 == 0 else i % 50 if i % 3 else 7, i, float(i % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, id long, v double").repartition(4)
    for order in (["x", "id"], ["s", "id"]):
        d = df.withColumn("s", F.concat(F.lit("key-é-"), F.lpad(F.col("x").cast("string"), 3, "0")))
        specs = [scan.Scan(k, F.col("v"), k) for k in KINDS]
        a = scan.scan(d, "g", order, specs, rows=40).toPandas().sort_values("id")
        b = scan.ordered(d, "g", order, specs, True).toPandas().sort_values("id")
        assert len(a) == len(b) == 400
        for k in KINDS:
            np.testing.assert_allclose(a[k].astype(float), b[k].astype(float), atol=1e-9, err_msg=k)
    assert scan.tile(df, "g", ["x", "id"], 40).groupBy("g", scan.TILE).count().agg(F.max("count")).first()[0] <= 40
    m = {r.g: (r.n, r.med) for r in quantiles.medians(df, ["g"], "v", rows=5).collect()}
    assert m == {r.g: (r.n, r.med) for r in quantiles.medians(df, ["g"], "v", bounded=True).collect()} and m[None][0] == 150
    wide = scan.moving(df, "g", "x", {"m": F.count("v")}, 2, 2, width=10)
    assert wide.count() == 400


@pytest.mark.parametrize("rows", [60, 10 ** 6])
@pytest.mark.parametrize("policy", interp.POLICIES)
def test_interp_join(spark, skewed, policy, rows):
    df, p = skewed
    keys = spark.createDataFrame([(0, float(k)) for k in list(np.linspace(-1, 500, 80)) + [p.x[0]]], "g int, x double")
    got = interp.interp_join(keys, df, "x", "v", ["g"], policy, rows=rows).toPandas().sort_values("x")
    t = p[(p.g == 0) & p.v.notna()].sort_values("x")
    tx, tv, q = t.x.to_numpy(), t.v.to_numpy(), got.x.to_numpy()
    want = np.interp(q, tx, tv)
    out = (q < tx[0]) | (q > tx[-1])
    if policy == "null":
        want[out] = np.nan
    elif policy == "nearest":
        want = tv[[int(np.argmin(np.abs(tx - k))) for k in q]]
    elif policy == "extrap":
        lo, hi = q < tx[0], q > tx[-1]
        want[lo] = tv[0] + (q[lo] - tx[0]) * (tv[1] - tv[0]) / (tx[1] - tx[0])
        want[hi] = tv[-1] + (q[hi] - tx[-1]) * (tv[-1] - tv[-2]) / (tx[-1] - tx[-2])
    np.testing.assert_allclose(got.v.astype(float), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rows", [40, 10 ** 6])
@pytest.mark.parametrize("method,np_method", [("linear", "linear"), ("midpoint", "hazen")])
def test_quantiles(skewed, rows, method, np_method):
    df, p = skewed
    got = quantiles.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, method, rows=rows).toPandas().set_index("g")
    for g, part in p.dropna().groupby("g"):
        want = np.quantile(part.v, [0.05, 0.5, 0.95], method=np_method)
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]].astype(float), want, atol=1e-12)


def test_robust_scale_tiled_and_plain(skewed):
    df, p = skewed
    a = quantiles.robust_scale(df, ["g"], "v", rows=50).toPandas().sort_values("g")
    b = quantiles.robust_scale(df, ["g"], "v").toPandas().sort_values("g")
    np.testing.assert_allclose(a[["med", "sd"]], b[["med", "sd"]], atol=1e-12)
    q = p[p.g == 0].v.dropna()
    assert abs(a.sd.iloc[0] - 1.4826 * np.median(np.abs(q - np.median(q)))) < 1e-12


def test_moving_tiles_equal_rolling(spark, rng):
    v = rng.normal(size=900)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "k": np.arange(900), "v": v}))
    got = scan.moving(df, "g", "k", {"m": F.avg("v")}, 3, 5, width=64).toPandas().sort_values("k")
    want = [v[max(0, k - 3):k + 6].mean() for k in range(900)]
    np.testing.assert_allclose(got.m, want, atol=1e-12)


def test_nearest_match_tiled(spark, skewed):
    df, p = skewed
    a = df.where("g = 0").select("g", "id", "x")
    b = df.where("g <> 0").select(F.lit(0).alias("g"), F.col("id").alias("bid"), "x")
    got = matching.nearest_match(a, b, "x", 5.0, ["g"], "bid", rows=50).toPandas()
    bx = p[p.g != 0].x.to_numpy()
    want = {i: np.abs(bx - x).min() for i, x in zip(p[p.g == 0].id, p[p.g == 0].x)}
    assert len(got) == sum(w <= 5 for w in want.values())
    np.testing.assert_allclose(got.gap, [want[i] for i in got.id], atol=1e-9)


def test_trapezoid_and_change_point_tiled(skewed):
    df, _ = skewed
    d = df.where("v is not null")
    for fn in (lambda r: firn.running_trapezoid(d, "x", "v", ["g"], rows=r).select("g", "id", F.round("integral", 6).alias("y")),
               lambda r: profiles.change_point(d, "x", "v", ["g"], min_contrast=0.0, rows=r).select("g", F.col("k").alias("id"), F.round("contrast", 9).alias("y"))):
        a, b = (fn(r).toPandas().sort_values(["g", "id"]).reset_index(drop=True) for r in (50, 10 ** 6))
        pd.testing.assert_frame_equal(a, b)


def test_tide_rate_tiled(spark, skewed):
    df, p = skewed
    tide = df.where("g = 0 and v is not null").select("x", "v")
    keys = spark.createDataFrame([(float(k),) for k in np.linspace(0, 50, 60)], "x double")
    a, b = (interp.tide_rate(keys, tide, "x", "v", rows=r).toPandas().sort_values("x") for r in (40, 10 ** 6))
    np.testing.assert_allclose(a.rate.astype(float), b.rate.astype(float), atol=1e-9)
    t = p[(p.g == 0) & p.v.notna()].sort_values("x")
    i = np.searchsorted(t.x, a.x)
    tx, tv = t.x.to_numpy(), t.v.to_numpy()
    want = [(tv[k + 1] - tv[k - 1]) / (tx[k + 1] - tx[k - 1]) if 2 <= k <= len(tx) - 3 else np.nan for k in i]
    np.testing.assert_allclose(a.rate.astype(float), want, rtol=1e-6)


def test_unwrap_tiled_equals_plain(spark, rng):
    n = 600
    p = pd.DataFrame({"line_id": np.repeat([1, 2, 3], n // 3), "bin": np.tile(np.arange(n // 3), 3), "phase": rng.uniform(-9, 9, n),
                      "coh": np.where(rng.random(n) < 0.25, 0.1, 0.8)})
    df = spark.createDataFrame(p).withColumn("ref_bin", F.when(F.col("line_id") != 3, 10 + 20 * F.col("line_id")))
    a, b = (unwrap.unwrap_from_reference(df, 1.0, ["line_id"], max_gap=2, bounded=bd, rows=40).select(
        "line_id", "bin", "dtau", "dtau_above_ref", "last_bin").toPandas().sort_values(["line_id", "bin"]).reset_index(drop=True) for bd in (None, True))
    np.testing.assert_allclose(a.astype(float), b.astype(float), atol=1e-9)
    assert a[a.line_id == 3].dtau.isna().all() and a[a.line_id == 1].dtau.notna().any()
