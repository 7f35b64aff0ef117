"""Networks, regressions, coherent scans and the modulus, against truth and dense solutions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echofold.functions.stats import betainc
from echofold.operators import coherent, flexure, network, pairs, quality, regress
from echofold.plans import chains

TRUTH = np.cumsum([0, .6, -.2, .9, .4, -.5, 1.1, .3, -.7, .8])
TRUTH = TRUTH - TRUTH.mean()
IJ = [(i, j) for i in range(10) for j in range(i + 1, 10)]


def net(spark, rows):
    return spark.createDataFrame([(int(r), i, j, float(d), 1.0) for r, i, j, d in rows], "row long, i int, j int, d double, w double")


def solve(spark, rows, **kw):
    ep, pr = network.invert_network(net(spark, rows), ["row"], "i", "j", "d", "w", **kw)
    return ep.toPandas().sort_values(["row", "epoch"]), pr.toPandas()


def test_network_noiseless_and_scaled_rows(spark):
    ep, _ = solve(spark, [(k, i, j, k * (TRUTH[j] - TRUTH[i])) for k in range(1, 41) for i, j in IJ])
    for k, part in ep.groupby("row"):
        np.testing.assert_allclose(part.x, k * TRUTH, atol=1e-9)


def test_network_beats_star(spark, rng):
    full, star = [], []
    for k in range(60):
        for i, j in IJ:
            d = TRUTH[j] - TRUTH[i] + 0.05 * rng.normal()
            full.append((k, i, j, d))
            if i == 0:
                star.append((k, i, j, d))
    err = lambda rows: math.sqrt(np.mean([(p.x.to_numpy() - TRUTH).var() for _, p in solve(spark, rows, n_sigma=1e9)[0].groupby("row")]))
    assert err(star) > 1.5 * err(full)


def test_network_rejects_and_points_at_the_bad_pair(spark, rng):
    rows = [(0, i, j, TRUTH[j] - TRUTH[i] + 0.05 * rng.normal() + (3.0 if k == 16 else 0)) for k, (i, j) in enumerate(IJ)]
    ep, pr = solve(spark, rows, n_sigma=6.0)
    kept, _ = solve(spark, rows, n_sigma=1e9)
    miss = lambda e: np.abs(np.diff(e.x.to_numpy() - TRUTH[e.epoch])).max()
    bad = pr[~pr.used]
    assert IJ[16] in set(zip(bad.i, bad.j)) and miss(ep) < 0.5 * miss(kept)
    # Weak noise keeps the scale above zero, so that only the limit decides.
    noise = lambda: 0.01 * rng.normal()
    _, pr = solve(spark, [(0, i, j, TRUTH[j] - TRUTH[i] + noise() + (1.0 if (i, j) == (2, 5) else 0)) for i, j in IJ], n_sigma=1e9)
    worst = pr.loc[pr.resid.abs().idxmax()]
    assert (worst.i, worst.j) == (2, 5)


def test_networks_that_close_exactly_keep_every_pair_and_epoch(spark, rng):
    """Residuals of rounding size are no outliers, whatever the size of the values."""
    rows = []
    for k in range(1000):
        x = np.round(rng.normal(size=7), 6) * 10.0 ** rng.integers(-6, 7)
        rows += [(k, i, j, x[j] - x[i]) for i in range(7) for j in range(i + 1, 7)]
    ep, pr = solve(spark, rows, n_sigma=2.0)
    assert pr.used.all() and len(pr) == 21_000 and len(ep) == 7000 and (ep.n_epoch == 7).all()


def test_network_unreachable_epochs_missing(spark):
    rows = [(0, i, j, TRUTH[j] - TRUTH[i]) for i, j in IJ if j < 5] + [(0, 8, 9, 1.0)]
    ep, pr = solve(spark, rows)
    assert ep.epoch.tolist() == [0, 1, 2, 3, 4] and ep.n_epoch.iloc[0] == 5
    ep, _ = solve(spark, rows[:5])
    assert len(ep) == 0


def test_complete_network_closed_form(spark, rng):
    rows = [(0, i, j, TRUTH[j] - TRUTH[i] + 0.1 * rng.normal()) for i, j in IJ]
    dense = solve(spark, rows, n_sigma=1e9)[0]
    closed = network.complete_network(net(spark, rows), ["row"], "i", "j", "d").toPandas().sort_values("epoch")
    np.testing.assert_allclose(closed.x, dense.x, atol=1e-9)


def test_largest_component(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 7, 8), (1, 8, 9), (1, 9, 10), (2, 5, 6), (2, 1, 2)], "g int, i int, j int")
    got = network.largest_component(e, "i", "j", ["g"]).toPandas()
    assert sorted(got[got.g == 1].node) == [7, 8, 9, 10] and sorted(got[got.g == 2].node) == [1, 2]


def test_chain_stops_at_a_gap(spark):
    steps = spark.createDataFrame([(0, k, None if k == 6 else float(k)) for k in range(1, 9)], "g int, k int, step double")
    got = network.chain_from_reference(steps, spark.createDataFrame([(0, 4)], "g int, ref_idx int"), ["g"]).toPandas().set_index("pass_idx").chained
    assert got.to_dict() == {4: 0.0, 5: 4.0, 6: 9.0, 3: -3.0, 2: -5.0, 1: -6.0}


M2 = 12.42 / 24
T = np.array([0, .11, .22, .35, .61, .9, 1.2, 1.55, 1.9, 2.2, 2.6, 2.9, 3.2])
TIDE = 0.55 * np.sin(2 * np.pi * T / M2 + 0.8) + 0.25 * np.sin(2 * np.pi * T / 1.0758 + 2.1)


def series(spark, y, t=T, h=TIDE):
    rows = [(b, k, None if np.isnan(v) else float(v), float(t[k]), float(h[k])) for b, ys in enumerate(y) for k, v in enumerate(ys)]
    return spark.createDataFrame(rows, "block int, pair int, y double, t double, h double")


def test_trend_and_driver_recovery(spark, rng):
    b, c = -80e-6 * (1 + 0.2 * rng.normal(size=24)), 120e-6 * np.cos(np.linspace(0, 3, 24))
    noisy = 3e-5 + b[:, None] * T + c[:, None] * TIDE + 5e-6 * rng.normal(size=(24, 13))
    got = regress.fit_trend_and_driver(series(spark, noisy), "y", "t", "h", ["block"]).toPandas().sort_values("block")
    assert (np.abs(got.trend - b) < 4.5 * got.trend_std).all() and (np.abs(got.driver - c) < 4.5 * got.driver_std).all()
    for k in (0, 11):
        X = np.column_stack([np.ones(13), T - T.mean(), TIDE - TIDE.mean()])
        beta, res = np.linalg.lstsq(X, noisy[k], rcond=None)[:2]
        np.testing.assert_allclose(got.loc[got.block == k, ["intercept", "trend", "driver"]].to_numpy()[0], beta, rtol=1e-8)
        sd = np.sqrt(res[0] / 10 * np.diag(np.linalg.inv(X.T @ X)))
        np.testing.assert_allclose(got.loc[got.block == k, ["trend_std", "driver_std"]].to_numpy()[0], sd[1:], rtol=1e-6)
    moved = regress.fit_trend_and_driver(series(spark, noisy - 0.3), "y", "t", "h", ["block"]).toPandas().sort_values("block")
    np.testing.assert_allclose(moved.driver, got.driver, rtol=1e-6)
    clean = regress.fit_trend_and_driver(series(spark, b[:, None] * T + c[:, None] * TIDE), "y", "t", "h", ["block"]).toPandas().sort_values("block")
    np.testing.assert_allclose(clean.trend, b, atol=1e-12)


def test_trend_and_driver_refusals(spark):
    y = np.outer([1.0, 2.0, 3.0], T)
    y[1, 3:] = np.nan
    y[2, :] = np.nan
    got = regress.fit_trend_and_driver(series(spark, y), "y", "t", "h", ["block"]).toPandas().set_index("block")
    assert got.n[1] == 3 and np.isnan(got.trend[1]) and 2 not in got.index
    same = regress.fit_trend_and_driver(series(spark, y[:1], h=2 * T), "y", "t", "h", ["block"]).toPandas()
    assert same.r_th[0] == pytest.approx(1) and np.isnan(same.driver[0])


def test_student_p():
    # Reference points of the two-sided t distribution.
    for t, dof, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (2.845340, 20, 0.01), (0.0, 5, 1.0)):
        assert abs(float(betainc(dof / (dof + t * t), dof / 2, 0.5)) - p) < 2e-6


def heights(spark, Z):
    nx, n_pass = Z.shape
    return spark.createDataFrame(pd.DataFrame({"line_id": 0, "col": np.repeat(np.arange(nx), n_pass), "pass_idx": np.tile(np.arange(n_pass), nx), "z": Z.ravel()}))


def gated(spark, Z, tide, **kw):
    td = None if tide is None else spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(tide)], "line_id long, pass_idx long, tide_m double")
    nx = Z.shape[0]
    b, p = regress.fit_slope_gated(heights(spark, Z), td, ["line_id"], F.floor(F.col("col") / 200), F.floor(F.col("col") / 200) < nx // 200, **kw)
    return b.toPandas().sort_values("block"), p.toPandas().sort_values("pass_idx")


def test_gated_slope(spark, rng):
    a = np.linspace(0.2, 1.4, 10)
    tide = rng.uniform(-0.5, 0.5, 13)
    Z = np.kron(a, np.ones(200))[:, None] * tide + 0.15 * rng.normal(size=(2000, 13))
    b, p = gated(spark, Z[:1990], tide)
    assert len(b) == 9                                     # the short last block is dropped
    b, p = gated(spark, Z, tide)
    assert (np.abs(b.a - a) / b.a_std).max() < 4.5 and (b.n >= 10).all()
    lm, _ = gated(spark, Z, None)
    np.testing.assert_allclose(lm.a.to_numpy()[3], np.polyfit(Z.mean(axis=0), Z[600:800].mean(axis=0), 1)[0], rtol=1e-9)
    Zu = Z + 0.1 * rng.normal(size=13)
    b, _ = gated(spark, Zu, tide)
    assert np.abs(b.a - a).max() < 0.15
    Zb = Z.copy()
    Zb[:, 4] += 1.0
    _, p = gated(spark, Zb, tide)
    assert 4 in p[~p.pass_ok].pass_idx.tolist() and p.pass_ok.sum() >= 9


def test_legendre_masks_bad_sigma(spark, rng):
    d = np.linspace(20, 500, 300)
    v = -1.2e-3 * d + 0.6e-3 * (d ** 2 / 500 - d) + 1e-5 * rng.normal(size=300)
    s = np.full(300, 1e-5)
    rows = lambda s: spark.createDataFrame(pd.DataFrame({"k": 0, "z": d, "v": v, "s": s})).withColumn("s", F.when(~F.isnan("s"), F.col("s")))
    fit = lambda s: regress.legendre_fit(rows(s), "z", "v", "s", ["k"], order=2, norm=500.0, per_look=5).first()
    good = fit(s)
    assert abs(good.s1 / -1.2e-3 - 1) < 0.01 and abs(good.s2 / 0.6e-3 - 1) < 0.02 and good.p_quad < 1e-6
    bad = s.copy()
    bad[0], bad[-1] = 0, np.nan
    worse = fit(bad)
    assert abs(worse.s1 - good.s1) < 0.02 * 1.2e-3 and abs(worse.s2 - good.s2) < 0.02 * 1.2e-3
    x = 2 * d / 500 - 1
    A = np.column_stack([np.ones(300), x, (3 * x * x - 1) / 2])
    np.testing.assert_allclose(good.coef, np.linalg.lstsq(A, v, rcond=None)[0], rtol=1e-7)


def test_correlated_legendre_matches_numpy(spark, rng):
    z = np.linspace(30, 220, 96)
    r = np.convolve(rng.normal(size=110), np.ones(6) / 6, "valid")[:96]
    y, s = 0.5 + 0.01 * z + r, np.full(96, 0.2)
    got = regress.legendre_correlated(spark.createDataFrame(pd.DataFrame({"k": 0, "z": z, "y": y, "s": s})), "z", "y", "s", ["k"]).first()
    x = 2 * (z - z[0]) / (z[-1] - z[0]) - 1
    P = np.column_stack([np.ones(96), x, (3 * x * x - 1) / 2])
    inv = np.linalg.inv(P.T @ P / 0.04)
    c = inv @ (P.T @ y / 0.04)
    e = y - P @ c
    chi2 = (e ** 2).sum() / 0.04 / 93
    q = e - e.mean()
    ac = np.correlate(q, q, "full")[95:]
    L = max(int(np.argmax(ac / ac[0] < 1 / np.e)), 1)
    assert got.corr_len == L and abs(got.chi2 / chi2 - 1) < 1e-9
    np.testing.assert_allclose(got.coef_sd, np.sqrt(np.diag(inv) * max(chi2, 1) * L), rtol=1e-8)


def field(spark, a, kz, dtide, ij, rng, noise=0.02, extra=0.0):
    rows = []
    for k, av in enumerate(a):
        ph = kz * av * dtide + noise * rng.normal(size=len(dtide)) + extra
        rows += [(k, i, j, float(math.cos(p)), float(math.sin(p)), 1.0, float(d)) for (i, j), p, d in zip(ij, ph, dtide)]
    return spark.createDataFrame(rows, "cell int, ref_idx int, sec_idx int, re double, im double, w double, dtide double")


def test_coherent_scans(spark, rng):
    ij = [(i, j) for i in range(15) for j in range(i + 1, 15)]
    tide = rng.uniform(-0.5, 0.5, 15)
    dt = np.array([tide[j] - tide[i] for i, j in ij])
    a, kz = 1e-3 * rng.uniform(-4, 4, 8), -54.4
    grid = coherent.grid_of(-25e-3, 25e-3, 1001)
    df = field(spark, a, kz, dt, ij, rng)
    got = coherent.coherent_scan_packed(df, ["cell"], F.lit(kz), "dtide", grid).toPandas().sort_values("cell")
    assert np.abs(got.a - a).max() < 0.35e-3 and got.f.min() > 0.8 and got.a_sd.notna().all()
    jvm = coherent.coherent_scan(df, ["cell"], F.lit(kz) * F.col("dtide"), grid[400:601]).toPandas().sort_values("cell")
    np.testing.assert_allclose(jvm.a, got.a, atol=1e-12)
    test = coherent.injection_self_test(df, ["cell"], F.lit(kz) * F.col("dtide"), grid[300:701], inject=24 * 0.05e-3).toPandas()
    assert test[~test.edge].err.max() < 1e-9
    fit = coherent.coherent_fit(df.withColumn("a0", F.lit(0.0)), ["cell"], F.lit(kz), ["dtide"], ["a0"], jackknife=False).toPandas().sort_values("cell")
    assert np.abs([t[0] for t in fit.theta] - a).max() < 0.35e-3


def test_coherent_2d_separates(spark, rng):
    ij = [(i, j) for i in range(12) for j in range(i + 1, 12)][:60]
    dt, res, kz = rng.uniform(-1, 1, 60), 0.4 * rng.normal(size=60), -54.4
    a, g = np.array([2e-3, -3e-3]), np.array([1.5e-3, -2e-3])
    rows = []
    for k in range(2):
        ph = kz * (a[k] * dt + g[k] * res) + 0.02 * rng.normal(size=60)
        rows += [(k, i, j, float(np.cos(p)), float(np.sin(p)), 1.0, float(x), float(y)) for (i, j), p, x, y in zip(ij, ph, dt, res)]
    df = spark.createDataFrame(rows, "cell int, ref_idx int, sec_idx int, re double, im double, w double, dt double, rg double")
    got = coherent.coherent_scan_2d(df, ["cell"], F.lit(kz), "dt", "rg", coherent.grid_of(-25e-3, 25e-3, 501), coherent.grid_of(-20e-3, 20e-3, 161)).toPandas().sort_values("cell")
    assert np.abs(got.a - a).max() < 0.5e-3 and np.abs(got.b - g).max() < 0.6e-3 and got.r_reg.abs().max() < 0.5


def test_jackknife_forms_agree(spark, rng):
    v = rng.uniform(1, 2, size=(40, 2))
    df = spark.createDataFrame([(0, int(k % 8), int((k * 3 + 1) % 8), float(a), float(b)) for k, (a, b) in enumerate(v)], "g int, i int, j int, a double, b double")
    fast = coherent.jackknife_sums(df, ["g"], ["i", "j"], {"a": F.col("a"), "b": F.col("b")}, {"r": lambda s: s["a"] / s["b"]}).first()
    slow = coherent.jackknife(df, ["g"], ["i", "j"], lambda d, by: d.groupBy(*by).agg((F.sum("a") / F.sum("b")).alias("r")), ["r"]).first()
    assert fast.n_r == slow.n_r == 8 and abs(fast.se_r / slow.se_r - 1) < 1e-9


def test_generator_draws(spark):
    # First states of the minimal-standard generator from seed state 1.
    got = coherent.bootstrap_index(spark, 2147483645, 5, 2).toPandas().sort_values(["rep", "k"])
    state, want = 2147483645 % 2147483646 + 1, []
    for _ in range(10):
        state = 16807 * state % 2147483647
        want.append(state)
    assert got.x.tolist() == want
    assert got.idx.tolist() == [min(5, int(x / 2147483647 * 5) + 1) for x in want]


def test_each_line_draws_from_its_own_pairs(spark):
    df = spark.createDataFrame([(g, k) for g, n in (("a", 10), ("b", 40), (None, 21)) for k in range(1, n + 1)], "line string, pair_no int")
    got = coherent.line_draws(df, ["line"], 5, 30).toPandas()
    for g, n in (("a", 10), ("b", 40), (None, 21)):
        mine = got[got.line.isna() if g is None else got.line == g]
        assert (mine.groupby("rep")._m.sum() == n).all() and mine.rep.nunique() == 30 and mine.pair_no.between(1, n).all() and mine.pair_no.nunique() == n
        want = coherent.bootstrap_index(spark, 5, n, 30).groupBy("rep", F.col("idx").alias("pair_no")).count().toPandas()
        assert set(map(tuple, mine[["rep", "pair_no", "_m"]].to_numpy())) == set(map(tuple, want.to_numpy()))


def test_common_lag(spark, rng):
    w, tau = 2 * np.pi / 24.84, 1.5
    amp = rng.normal(size=80)
    rows = [(0, float(m * np.cos(w * tau) + 0.01 * rng.normal()), float(-m * np.sin(w * tau) + 0.01 * rng.normal()), 0.01, 0.01) for m in amp]
    got = coherent.common_lag(spark.createDataFrame(rows, "k int, a double, b double, sa double, sb double"), ["k"], "a", "b", "sa", "sb").first()
    assert abs(got.tau_h - tau) < 0.05 and got.tau_lo <= got.tau_h <= got.tau_hi


def test_flags_need_both_z_and_floor(spark):
    rows = [(0, k, 0.9 + 0.001 * (k % 3)) for k in range(12)] + [(0, 12, 0.8), (0, 13, 0.88)]
    df = spark.createDataFrame(rows, "line_id int, pass_idx int, q double")
    got = quality.robust_flags(df, [("coalign", "q", -1, 0.85)], ["line_id"], ["pass_idx"]).toPandas()
    assert got[got.flag].pass_idx.tolist() == [12] and got[got.flag].why.iloc[0].startswith("coalign(z+")


def test_modulus_round_trip(spark, rng):
    E, h, x0 = 2.4e9, 280.0, 3000.0
    lam = (4 * E * h ** 3 / (12 * 0.91) / (1028 * 9.81)) ** 0.25
    x = np.arange(0, 14001, 200.0)
    b = np.maximum(x - x0, 0) / lam
    y = 1 - np.exp(-b) * (np.cos(b) + np.sin(b)) + 0.01 * rng.normal(size=len(x))
    obs = spark.createDataFrame(pd.DataFrame({"line_id": 1, "kind": "shape", "x": x, "y": y, "sigma": 0.01, "width": 0.0}))
    two = obs.unionByName(obs.withColumn("line_id", F.lit(2).cast("long")))
    def predict(c):
        b = F.greatest(F.col("x") - F.col("x0"), F.lit(0.0)) / F.pow(4 * F.col("E") * h ** 3 / (12 * 0.91) / (1028 * 9.81), F.lit(0.25))
        return c.withColumn("pred", 1 - F.exp(-b) * (F.cos(b) + F.sin(b)))

    fit, prof = chains.modulus(two, predict, flexure.log_grid(0.2e9, 20e9, 41), [1000.0 + 250 * k for k in range(17)])
    got = fit.toPandas()
    assert got.interior.all() and (got.n_min == 1).all() and abs(math.log(got.E_fine[0] / E)) < math.log(1.15)
    assert abs(got.x0_fine[0] - x0) < 500 and got.E_lo[0] < got.E_fine[0] < got.E_hi[0] and abs(got.amp_fine[0] - 1) < 0.05
    both = flexure.combine_profiles(prof, "line_id").first()
    assert both.n_lines == 2 and both.E_hi / both.E_lo < got.E_hi[0] / got.E_lo[0]


def test_make_pairs_modes(spark):
    p = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, None), ("a", 4, True), ("b", 9, True)], "line_id string, pass_idx int, enabled boolean")
    ids = lambda m, **k: sorted((r.ref_idx, r.sec_idx) for r in pairs.make_pairs(p, m, **k).collect())
    assert ids("all") == [(1, 3), (1, 4), (3, 4)] and ids("sequential") == [(1, 3), (3, 4)]
    assert ids("main", main_idx=F.lit(3)) == [(3, 1), (3, 4)]
    want = spark.createDataFrame([("a", 1, 2), ("a", 4, 1), ("a", 3, 3)], "line_id string, ref_idx int, sec_idx int")
    assert ids(want) == [(4, 1)]
    m = pairs.pass_slice_map(p.where("line_id = 'a'"), 1).toPandas().sort_values("pass_idx")
    assert m.slice_idx.fillna(0).tolist() == [1, 0, 2, 3] and m.is_main.tolist() == [True, False, False, False]
    with pytest.raises(Exception, match="main pass"):
        pairs.pass_slice_map(p.where("line_id = 'a'"), 2).collect()


def test_network_chain_recovers_response(spark, rng):
    """Pairs to network to response: a known trend and driver come back."""
    ep = np.arange(10)
    h = rng.normal(size=10)
    rows = []
    for r in range(5):
        x = 0.2 * r * ep + (r - 2) * h
        rows += [(r, i, j, float(x[j] - x[i] + 1e-3 * rng.normal()), 1.0) for i, j in IJ]
    df = spark.createDataFrame(rows, "row long, ref_idx int, sec_idx int, d double, w double")
    drv = spark.createDataFrame([(int(e), float(e), float(v)) for e, v in zip(ep, h)], "epoch int, t double, h double")
    fit = chains.network_response(df, drv, ["row"], "w")[0].toPandas().sort_values("row")
    np.testing.assert_allclose(fit.trend, 0.2 * np.arange(5), atol=2e-3)
    np.testing.assert_allclose(fit.driver, np.arange(5) - 2, atol=5e-3)


@pytest.mark.parametrize("width", [4, 7, 512])
def test_repeatable_residual_equals_all_pairs(spark, rng, width):
    """Lines of one and of many tiles, gaps, blocks short of passes or without variation, an even and an odd number of pairs."""
    rows, want = [], {}
    for line, nb in (("a", 23), ("b", 6), (None, 12), ("c", 1), ("d", 2)):
        M = rng.normal(size=(nb, 9)) + 0.8 * rng.normal(size=9)
        M[rng.random(M.shape) < 0.15] = np.nan
        M[0] = 0.25
        if line == "d":
            M[1, 3:] = np.nan
        rho = []
        for i in range(nb):
            for j in range(i + 1, nb):
                ok = np.isfinite(M[i]) & np.isfinite(M[j])
                if min(np.isfinite(M[i]).sum(), np.isfinite(M[j]).sum(), ok.sum()) >= 6 and np.ptp(M[i][ok]) > 0 and np.ptp(M[j][ok]) > 0:
                    rho.append(np.corrcoef(M[i][ok], M[j][ok])[0, 1])
        want[line] = (np.median(rho) if rho else None, len(rho))
        rows += [(line, b, e, None if np.isnan(M[b, e]) else float(M[b, e])) for b in range(nb) for e in range(9)]
    df = spark.createDataFrame(rows, "line string, block long, pass int, resid double")
    got = {r.line: (r.rho, r.n_pairs) for r in regress.repeatable_residual(df, ["line"], "block", "pass", width=width).collect()}
    assert set(got) == set(want)
    for k, (rho, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if rho is None else abs(got[k][0] - rho) < 1e-12), k


def test_order_of_doubles_is_kept():
    v = np.array([-1.0, -0.5, -1e-300, -0.0, 0.0, 1e-300, 0.3, 0.30000000000000004, 1.0])
    k = regress._rank_key(v)
    assert (np.diff(k.astype(object)) >= 0).all() and (regress._of_key(k.view(np.int64).copy()) == v).all()
