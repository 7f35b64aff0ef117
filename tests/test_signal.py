"""Interferograms, unwrapping, alignment and the whole pair chain on synthetic traces."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echofold.operators import align, blocks, firn, interferogram, pairs, profiles, quality, unwrap
from echofold.params import C_LIGHT, FirnParams, PairOptions
from echofold.plans import chains


def frame(spark, rows, **kw):
    return spark.createDataFrame(pd.DataFrame(rows), **kw)


def conv_same(x, k):
    """Boxcar sums over (rows, columns), zero outside, as a two-dimensional 'same' convolution."""
    def one(a, n):
        lo, hi = (n - 1) // 2, n // 2
        return np.array([a[max(0, i - lo): i + hi + 1].sum(axis=0) for i in range(len(a))])
    return one(one(x, k[0]).T, k[1]).T


@pytest.mark.parametrize("win", [(5, 15), (4, 6)])
def test_multilook_matches_dense(spark, rng, win):
    nt, nx = 30, 50
    s = rng.normal(size=(2, nx, nt)) + 1j * rng.normal(size=(2, nx, nt))
    s[0, 7, 3] = np.nan
    rows = [dict(line_id=0, pass_idx=p, col=c, re=s[p, c].real.tolist(), im=s[p, c].imag.tolist()) for p in range(2) for c in range(nx)]
    df = frame(spark, rows)
    lo, hi = interferogram._reach(win[1])
    tiles = interferogram.tile_columns(df, 12, lo, hi)
    p = pairs.pair_samples(tiles, key=["line_id", "col_tile", "col"])
    ig = interferogram.drop_halo(interferogram.multilook(interferogram.explode_samples(p), win, within=["col_tile"]), 12).toPandas()
    a, b = s[0].T, s[1].T
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = np.where(ok, a, 0), np.where(ok, b, 0)
    num, cnt = conv_same(b * a.conj(), win), conv_same(ok.astype(float), win)
    den = np.sqrt(conv_same(abs(a) ** 2, win) * conv_same(abs(b) ** 2, win))
    assert len(ig) == nt * nx
    at = (ig.bin.to_numpy(), ig.col.to_numpy())
    np.testing.assert_allclose(ig.re + 1j * ig.im, (num / cnt)[at], atol=1e-10)
    np.testing.assert_allclose(ig.coh, np.minimum(abs(num) / den, 1)[at], atol=1e-10)


def test_complex_block_micro_case(spark):
    rows = [dict(line_id=0, ref_idx=0, sec_idx=1, col=c, bin=b, re=math.cos(0.7), im=math.sin(0.7), coh=0.1 if c == 6 else 0.9)
            for c in range(40) for b in range(60)]
    ref = spark.createDataFrame([(0, c, None if c == 2 else 4) for c in range(40)], "line_id long, col long, ref_bin int")
    got = interferogram.complex_block_mean(frame(spark, rows), ref, 20, 0.3, [9, 19, 29]).toPandas()
    np.testing.assert_allclose(np.hypot(got.re, got.im), 1, atol=1e-12)
    np.testing.assert_allclose(np.arctan2(got.im, got.re), 0, atol=1e-12)
    assert abs(got[got.block == 0].w.iloc[0] - 16.2) < 1e-9 and abs(got[got.block == 1].w.iloc[0] - 18) < 1e-9


def test_reference_bin_and_missing_surfaces(spark):
    nt, nx, dt, fc = 400, 60, 1 / 300e6, 750e6
    t = np.arange(nt) * dt
    surf = np.full(nx, 0.3e-6)
    surf[4], surf[11], surf[19] = np.nan, t[-1], -1e-7
    truth = np.linspace(0, 30e-12, nt)
    sf = spark.createDataFrame([(0, c, None if np.isnan(v) else float(v)) for c, v in enumerate(surf)], "line_id int, col int, s double")
    sf = sf.withColumn("ref_bin", unwrap.reference_bin(F.col("s"), F.lit(0.0), F.lit(dt), F.lit(nt), 50e-9))
    rows = pd.DataFrame({"line_id": 0, "col": np.repeat(np.arange(nx), nt), "bin": np.tile(np.arange(nt), nx),
                         "phase": np.tile(np.angle(np.exp(-2j * np.pi * fc * truth)), nx), "coh": 0.9})
    d = unwrap.unwrap_from_reference(spark.createDataFrame(rows).join(sf, ["line_id", "col"]), fc, ["line_id", "col"]).toPandas()
    r = round((0.3e-6 + 50e-9) / dt)
    for c in (4, 11, 19):
        assert d[d.col == c].dtau.isna().all() and d[d.col == c].dtau_above_ref.isna().all()
    one = d[d.col == 0].sort_values("bin")
    np.testing.assert_allclose(one.dtau[one.bin >= r], truth[r:] - truth[r], atol=1e-15)
    np.testing.assert_allclose(one.dtau_above_ref[one.bin < r], truth[:r] - truth[r], atol=1e-15)


def test_long_gap_cuts_below(spark):
    coh = np.full(60, 0.9)
    coh[20:23] = 0.1     # 4 bad steps: tolerated
    coh[40:46] = 0.1     # 7 bad steps: cut
    df = frame(spark, {"line_id": 0, "col": 0, "bin": np.arange(60), "phase": 0.0, "coh": coh, "ref_bin": 5})
    d = unwrap.unwrap_from_reference(df, 1.0, ["line_id", "col"], max_gap=4).toPandas().sort_values("bin")
    assert d[d.dtau.notna()].bin.max() == 39 and d.dtau.notna().sum() == 35 - 3


def test_block_average_matches_dense(spark, rng):
    nx, block = 50, 20
    d, coh = rng.normal(size=nx) + 1e6, rng.uniform(0, 1, nx)
    d[3] = np.nan
    df = frame(spark, {"line_id": 0, "bin": 0, "col": np.arange(nx), "dtau": d, "coh": coh}).withColumn("dtau", F.when(~F.isnan("dtau"), F.col("dtau")))
    span = F.least(F.lit(block), nx - F.floor(F.col("col") / block) * block)
    for bounded in (True, False):
        got = blocks.block_average(df, ["line_id", "bin"], F.floor(F.col("col") / block), span, coh_thr=0.5, cols_per_look=2,
                                   bounded=bounded).toPandas().sort_values("block")
        for b in range(3):
            i = slice(b * block, min(nx, (b + 1) * block))
            w = np.where((coh[i] >= 0.5) & np.isfinite(d[i]), coh[i], 0)
            mu = np.nansum(w * np.nan_to_num(d[i])) / w.sum()
            sd = math.sqrt((w * (np.nan_to_num(d[i]) - mu) ** 2).sum() / w.sum())
            ne = max(w.sum() ** 2 / (w ** 2).sum() / 2, 1)
            row = got.iloc[b]
            np.testing.assert_allclose([row["mean"], row.scatter, row.n_eff, row["std"], row.coverage],
                                       [mu, sd, ne, sd / math.sqrt(ne), (w > 0).mean()], rtol=1e-9)


def bandlimited(rng, n, shift=0.0):
    f = np.fft.fftfreq(n)
    spec = np.exp(-(f / 0.15) ** 2) * np.fft.fft(rng.normal(size=n) + 1j * rng.normal(size=n))
    return np.fft.ifft(spec), np.fft.ifft(spec * np.exp(-2j * np.pi * f * shift))


def test_window_shift_recovers_delay(spark):
    i = np.arange(121)
    pulse = lambda at: np.exp(-((i - at) / 4) ** 2)
    rows = [dict(line_id=0, ref_idx=0, sec_idx=k, win=0, x_win=0.0, ref_p=pulse(60).tolist(), sec_p=pulse(60 + s).tolist())
            for k, s in enumerate([0.5, -1.25, 2.0, 5.0])]
    got = align.window_shift(frame(spark, rows)).toPandas().sort_values("sec_idx")
    np.testing.assert_allclose(got["shift"][:3].astype(float), [0.5, -1.25, 2.0], atol=1 / 32)
    assert got.accepted.tolist() == [True, True, True, False]      # the last peak lies beyond the search


def test_shift_profile_rules(spark):
    win = spark.createDataFrame([(0, 0, 1, 10.0, 1.0, True), (0, 0, 1, 30.0, 2.0, True), (0, 0, 2, 10.0, 3.0, True), (0, 0, 2, 30.0, 9.0, False)],
                                "line_id int, ref_idx int, sec_idx int, x_win double, shift double, accepted boolean")
    cols = spark.createDataFrame([(0, 0, p, c) for p in (1, 2, 3) for c in range(0, 41, 10)], "line_id int, ref_idx int, sec_idx int, col int")
    d = align.shift_profile(win, cols, 1.0).toPandas().sort_values(["sec_idx", "col"])
    assert d[d.sec_idx == 1].delay.tolist() == [1, 1, 1.5, 2, 2]
    assert d[d.sec_idx == 2].delay.tolist() == [3] * 5 and d[d.sec_idx == 3].delay.isna().all()


def test_apply_delay_undoes_a_shift(spark, rng):
    dt, fc, n = 3e-9, 7.5e8, 256
    a, b = bandlimited(rng, n, 0.4)
    b = b * np.exp(-2j * np.pi * fc * 0.4 * dt)
    df = frame(spark, [dict(k=0, re=b.real.tolist(), im=b.imag.tolist(), delay=0.4 * dt), dict(k=1, re=b.real.tolist(), im=b.imag.tolist(), delay=float("nan"))])
    got = align.apply_delay(df, fc, dt).toPandas().sort_values("k")
    np.testing.assert_allclose(np.array(got.re[0]) + 1j * np.array(got.im[0]), a, atol=1e-9)
    np.testing.assert_allclose(got.re[1], b.real)


def test_coherent_shift_and_layer_delay(spark, rng):
    rows, prof_a, prof_b, n = [], 0, 0, 200
    for c in range(12):
        a, b = bandlimited(rng, n, 0.13)
        rows += [dict(line_id=0, sec_idx=1, col=c, bin=i, ref_re=a[i].real, ref_im=a[i].imag, sec_re=b[i].real, sec_im=b[i].imag) for i in range(n)]
        prof_a, prof_b = prof_a + abs(a) ** 2, prof_b + abs(b) ** 2
    got = quality.coherent_shift(frame(spark, rows), [-0.4 + 0.01 * k for k in range(81)], (20, 180), ["line_id", "sec_idx"]).first()
    assert abs(got["shift"] + 0.13) < 0.01 or abs(got["shift"] - 0.13) < 0.01
    # The sign: a pass later by 0.13 bins comes out at +0.13.
    assert got["shift"] > 0
    rec = quality.shift_injection(frame(spark, rows), [-0.4 + 0.01 * k for k in range(81)], (20, 180), ["line_id", "sec_idx"]).first()
    assert abs(rec.recovery - 1) < 0.05
    d = quality.layer_delay(frame(spark, [dict(k=0, p_ref=prof_a.tolist(), p_sec=prof_b.tolist())]), ["k"]).first()
    assert abs(d["delay"] - 0.13) < 0.06


def test_track_layer_follows_the_base(spark, rng):
    z, nc = np.arange(401.0), 200
    base = np.where(np.arange(nc) < 160, 285.0, 285 - (np.arange(nc) - 160) / 40 * 75)
    img = -40 + rng.normal(size=(401, nc)) + 25 * np.exp(-((z[:, None] - base[None]) / 2) ** 2)
    rows = pd.DataFrame({"line_id": 0, "col": np.tile(np.arange(nc), 401), "z": np.repeat(z, nc), "db": img.ravel()})
    got = profiles.track_layer(spark.createDataFrame(rows)).toPandas().sort_values("col")
    assert np.abs(got.depth - base).max() <= 6 and np.abs(got.depth - base)[10:150].max() <= 3


@pytest.mark.parametrize("width", [1, 3, 7, 300])
def test_track_layer_is_the_same_for_all_tiles(spark, width, monkeypatch):
    """Against a plain walk along the whole image, with gaps that end the path on some lines; few maps are put together at a time."""
    monkeypatch.setattr(profiles, "FOLD", 4)
    r = np.random.default_rng(3)
    z, parts, want = np.arange(100.0, 160.0, 2.0), [], {}
    for line, nc in ((0, 61), (1, 40), (2, 1), (3, 2), (4, 33)):
        img = r.normal(size=(len(z), nc)).round(3) + 9 * np.exp(-((z[:, None] - 130 - 8 * np.sin(np.arange(nc) / 5)) / 3) ** 2)
        img[r.random(img.shape) < 0.1] = np.nan
        if line == 1:
            img[:, 31] = np.nan
            img[0, 31] = 1.0
        if line == 4:
            img[10:22, 16] = np.nan
        c = np.arange(nc) * 3 + 10
        k = pd.DataFrame({"line_id": line, "col": np.tile(c, len(z)), "z": np.repeat(z, nc), "db": img.ravel()}).dropna()
        parts.append(k)
        cols = np.array(sorted(k.col.unique()))
        full = k.pivot(index="z", columns="col", values="db").reindex(index=sorted(k.z.unique())).to_numpy()
        mean = lambda a, n, ax: pd.DataFrame(a if ax == 0 else a.T).rolling(n, center=True, min_periods=1).mean().to_numpy()
        sm = np.where(np.isfinite(full), mean(mean(full, 5, 0), 3, 1).T, -np.inf)
        zz, n = np.array(sorted(k.z.unique())), len(cols)
        seed = (n + 1) // 2 - 1
        path = np.full(n, np.nan)
        v = np.where((zz >= 110) & (zz <= 150), sm[:, seed], -np.inf)
        path[seed] = zz[v.argmax()] if v.max() > -np.inf else np.nan
        for steps in (range(seed + 1, n), range(seed - 1, -1, -1)):
            d = path[seed]
            for j in steps:
                v = np.where((np.abs(zz - d) <= 5) & (zz >= 104), sm[:, j], -np.inf)
                d = zz[v.argmax()] if v.max() > -np.inf else np.nan
                path[j] = d
        out = pd.Series(path).rolling(5, center=True, min_periods=1).median().where(~np.isnan(path)).to_numpy(copy=True)
        h = min(2, n // 2)
        if h:
            out[:h], out[-h:] = path[:h], path[-h:]
        want |= {(line, int(a)): b for a, b in zip(cols, out)}
    df = spark.createDataFrame(pd.concat(parts))
    got = profiles.track_layer(df, window=(110.0, 150.0), step=5.0, zmin=104.0, smooth=5, width=width).toPandas()
    mine = {(a, b): float(d) if not pd.isna(d) else np.nan for a, b, d in got.itertuples(index=False)}
    assert set(mine) == set(want) and any(np.isnan(v) for v in want.values())
    np.testing.assert_array_equal([mine[k] for k in want], list(want.values()))


@pytest.mark.parametrize("k", [1, 4, 9, 2001])
def test_moving_median_over_tiles_equals_rolling(spark, k):
    """Gaps, ties, a NULL group, other columns; windows within one tile, over several and wider than the group."""
    r = np.random.default_rng(k)
    n, parts = 700, []
    for g in ("a", None):
        v = r.integers(0, 40, n) / 4
        v[r.random(n) < 0.2] = np.nan
        parts.append(pd.DataFrame({"g": g, "k": r.permutation(n), "v": v, "note": "x"}))
    p = pd.concat(parts).reset_index(drop=True)
    df = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = profiles.moving_median(df, ["g"], "k", "v", k, width=64).toPandas()
    assert list(got.columns) == ["g", "k", "v", "note", "med"] and len(got) == 2 * n
    for g, part in p.groupby("g", dropna=False):
        t = part.sort_values("k").v.reset_index(drop=True)
        want = t.rolling(k, center=True, min_periods=1).median().to_numpy(copy=True)
        h = min(k // 2, n // 2)
        if h:
            want[:h], want[-h:] = t[:h], t[-h:]
        mine = got[got.g.isna() if pd.isna(g) else got.g == g].sort_values("k").med.to_numpy(float)
        np.testing.assert_array_equal(mine, want)


def test_firn_table_and_depth(spark):
    for p in (FirnParams(), FirnParams(mixing="looyenga", max_depth=300, nz=1201)):
        t = firn.firn_table(spark, p).toPandas().sort_values("d")
        beta = math.log(1 / p.rho_sfc - 1)
        rho = np.minimum(1 / (1 + np.exp(beta + (math.log(1 / p.rho_bco - 1) - beta) * t.d / p.bco_depth)), 1)
        n = 1 + 0.845 * rho * 0.917 if p.mixing == "kovacs" else (1 + rho * (3.15 ** (1 / 3) - 1)) ** 1.5
        tw = 2 / C_LIGHT * np.concatenate([[0], np.cumsum(np.diff(t.d) * (n.to_numpy()[1:] + n.to_numpy()[:-1]) / 2)])
        np.testing.assert_allclose(t.twtt, tw, rtol=1e-12)
        q = [-1e-9, 0.0, 3.3e-7, float(tw[-1]), float(tw[-1]) * 1.01]
        got = firn.depth_from_twtt(spark.createDataFrame([(float(v),) for v in q], "tau double"), F.col("tau"), firn.firn_table(spark, p), p).toPandas().sort_values("tau")
        want = np.interp(q, tw, t.d)
        assert np.isnan(got.depth.iloc[0]) and np.isnan(got.depth.iloc[4])
        np.testing.assert_allclose(got.depth.iloc[1:4], want[1:4], atol=1e-9)
        np.testing.assert_allclose(got.n_local.iloc[1:4], np.interp(want[1:4], t.d, n), atol=1e-9)


def test_pair_chain_recovers_strain(spark, rng):
    """Known strain to traces to strain, through every step of the chain."""
    fc, dt, nt, nx, surf, days = 750e6, 1 / 300e6, 1000, 240, 0.2e-6, 3.0
    S1, S2, H = -1.2e-3, 0.6e-3, 250.0
    par = FirnParams(max_depth=400, nz=1601)
    table = firn.firn_table(spark, par).toPandas().sort_values("d")
    t = np.arange(nt) * dt
    d = np.interp(t - surf, table.twtt, table.d, left=np.nan, right=np.nan)
    n = np.interp(d, table.d, table.n)
    v = S1 * d + S2 * (d ** 2 / H - d)
    tau = np.where(np.isfinite(d), v * days / 365.25 * 2 * n / C_LIGHT, 0)
    gamma = np.where(np.isfinite(d), 0.97 * np.exp(-np.nan_to_num(d) / 2000), 0)
    amp = np.where(np.isfinite(d), 10 ** (-np.nan_to_num(d) / 1200), 0)
    noise = lambda: amp[:, None] * (rng.normal(size=(nt, nx)) + 1j * rng.normal(size=(nt, nx))) / math.sqrt(2)
    ref = noise()
    sec = (np.sqrt(gamma) * np.exp(-2j * np.pi * fc * tau))[:, None] * ref + np.sqrt(1 - gamma)[:, None] * noise()
    rows = [dict(line_id=0, pass_idx=p, col=c, re=s[:, c].real.tolist(), im=s[:, c].imag.tolist()) for p, s in enumerate((ref, sec)) for c in range(nx)]
    slc = frame(spark, rows).repartition(8)
    axis = spark.createDataFrame([(0, fc, 0.0, dt, nt)], "line_id long, fc double, t0 double, dt double, nt int")
    cols = slc.select("line_id", "col").distinct()
    surface = cols.withColumn("surface_twtt_s", F.lit(surf))
    want = spark.createDataFrame([(0, 0, 1)], "line_id long, ref_idx long, sec_idx long")
    iv = want.join(cols, "line_id").withColumn("dt_s", F.lit(days * 86400))
    opt = PairOptions(ref_offset_s=50e-9, block_size=120, fit_bottom=250.0, min_samples=50)
    prof = chains.pair_profiles(slc, axis, surface, want, iv, opt, par)
    fit = chains.pair_strain(prof, opt).toPandas()
    assert len(fit) == 2 and fit.s1.notna().all()
    H_used = fit.bottom.mean()
    # S1 and S2 refer to the fitted depth range: eps = S1 + S2 (2 d / H - 1).
    s1 = S1 + S2 * (H_used / H - 1)
    assert abs(fit.s1.mean() / s1 - 1) < 0.05 and abs(fit.s2.mean() / (S2 * H_used / H) - 1) < 0.12


def test_samples_that_are_not_finite_are_missing(spark):
    """One infinite and one NaN sample count for nothing; everything around them stays finite."""
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, 1, c, b, inf if (c, b) == (2, 2) else nan if (c, b) == (0, 4) else 1.0, 0.5, 1.0, -0.5) for c in range(5) for b in range(5)]
    df = spark.createDataFrame(rows, "line_id int, ref_idx int, sec_idx int, col long, bin long, ref_re double, ref_im double, sec_re double, sec_im double")
    got = interferogram.multilook(df, (3, 3)).toPandas()
    value = got.select_dtypes("number").to_numpy(float)
    assert len(got) == 25 and np.isfinite(value).all()
    power = df.select("line_id", F.lit(0).alias("pass_idx"), "col", "bin", F.col("ref_re").alias("re"), F.col("ref_im").alias("im"))
    section = profiles.mean_power_section(power, 1).toPandas()
    assert section.db.isna().sum() <= 2 and abs(section.db.max()) < 1e-9


def test_track_layer_with_ragged_columns(spark):
    """Columns that lack depths, one without any near depth, and a window that no depth lies in."""
    rows = [(1, c, float(z), 10.0 if z == 300 else 0.0) for c in range(7) for z in range(260, 340, 5) if not (c == 2 and z > 320)]
    rows += [(2, c, float(z), 1.0) for c in range(3) for z in (10, 20)]
    got = profiles.track_layer(spark.createDataFrame(rows, "line_id long, col long, z double, db double"), smooth=3).toPandas()
    one = got[got.line_id == 1].sort_values("col")
    assert len(one) == 7 and one.depth.notna().all() and (one.depth.astype(float) - 300).abs().max() <= 15
    assert got[got.line_id == 2].depth.isna().all()
