"""The entry chains: pairs to block profiles, network to response, coherent stack, modulus."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions import columns as C
from echofold.operators import align, blocks, coherent, firn, flexure, interferogram, interp, network, pairs, regress, unwrap
from echofold.operators.pairs import PAIR
from echofold.params import FirnParams, PairOptions
from echofold.session import cut_lineage


def pair_profiles(slc: DataFrame, axis: DataFrame, surface: DataFrame, wanted: DataFrame, intervals: DataFrame,
                  opt: PairOptions = PairOptions(), firn_par: FirnParams = FirnParams()) -> DataFrame:
    """Traces to block displacement profiles of every wanted pair.

    slc: line_id, pass_idx, col, re, im (packed); axis: line_id, fc, t0, dt, nt;
    surface: line_id, col, surface_twtt_s; wanted: PAIR; intervals: PAIR, col,
    dt_s. Traces are exchanged once, into column tiles as wide as a block; the
    products, coherence, unwrapping and block sums then stay in their tile, and
    what leaves it is one row per (pair, block, bin).
    """
    (b_lo, b_hi), width = interferogram._reach(opt.window[1]), opt.block_size
    tiles = interferogram.tile_columns(slc, width, b_lo, b_hi)
    samples = pairs.pair_samples(tiles, wanted, key=["line_id", "col_tile", "col"])
    ig = interferogram.multilook(interferogram.explode_samples(samples), opt.window, within=["col_tile"])
    ig = interferogram.drop_halo(ig, width)
    ref = surface.join(axis, "line_id").withColumn("ref_bin", unwrap.reference_bin(
        F.col("surface_twtt_s"), F.col("t0"), F.col("dt"), F.col("nt"), opt.ref_offset_s))
    info = interferogram.tile_table(ref, width, ["ref_bin"], {
        "fc": F.first("fc"), "t0": F.first("t0"), "dt": F.first("dt"), "_span": F.count(F.lit(1)), "_s": F.avg("surface_twtt_s")})
    ig = interferogram.attach_by_tile(ig, info.drop("t0", "dt", "_s"), width, ["ref_bin"]).withColumn("phase", F.atan2("im", "re"))
    trace = ["line_id", "col_tile", "ref_idx", "sec_idx", "col"]
    un = unwrap.unwrap_from_reference(ig, F.col("fc"), trace, opt.coherence_threshold, opt.max_gap_bins, opt.phase_sign)
    block = F.floor(F.col("col") / width)
    avg = blocks.block_average(un, [*PAIR, "bin"], block, F.col("_span"), coh_thr=opt.coherence_threshold, min_coverage=opt.min_coverage,
                               cols_per_look=opt.cols_per_look, within=["col_tile"])
    geo = info.select("line_id", F.col("col_tile").alias("block"), "t0", "dt", "_s")
    # A mean surface on a bin is that bin: its rounding must not put the bin above the surface, where there is no depth.
    below = F.col("t0") + F.col("dt") * F.col("bin") - F.col("_s")
    avg = avg.join(geo, ["line_id", "block"]).withColumn("twtt", F.when(F.abs(below) > 1e-9 * F.abs("dt"), below).when(below.isNotNull(), 0.0))
    table = firn.firn_table(slc.sparkSession, firn_par)
    disp = firn.to_displacement(avg, F.col("twtt"), table, firn_par)
    dt = intervals.groupBy(*PAIR, block.alias("block")).agg(F.avg("dt_s").alias("dt_s"))
    return firn.to_velocity(disp, dt, [*PAIR, "block"]).drop("_s", "t0")


def pair_strain(profiles: DataFrame, opt: PairOptions = PairOptions(), p_value: bool = True) -> DataFrame:
    """Legendre strain of every pair and block; fits over too short a range are blanked."""
    fit = regress.legendre_fit(profiles, "depth", "v", "v_scatter", [*PAIR, "block"], coh="coh", order=opt.fit_order, top=opt.fit_top,
                               bottom=opt.fit_bottom, per_look=opt.bins_per_look, min_samples=opt.min_samples, p_value=p_value)
    return regress.mask_short_blocks(fit, opt.min_fit_range)


def align_pairs(slc: DataFrame, axis: DataFrame, surface: DataFrame, wanted: DataFrame, opt: PairOptions, fc: float, dt: float
                ) -> tuple[DataFrame, DataFrame]:
    """Delays of every wanted pair from windowed power profiles. Returns (delay per column, summary per pair)."""
    mid = surface.join(axis, "line_id").groupBy("line_id").agg(
        unwrap.reference_bin(F.avg("surface_twtt_s"), F.first("t0"), F.first("dt"), F.first("nt")).alias("_b0"))
    z = slc.select("line_id", "pass_idx", "col", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "_s")).select(
        "line_id", "pass_idx", "col", "bin", "_s.re", "_s.im").join(mid, "line_id")
    near = F.abs(F.col("bin") - F.col("_b0")) <= opt.coalign_half_win
    nx = slc.groupBy("line_id").agg((F.max("col") + 1).alias("nx"))
    power = align.window_power(z, nx, opt.coalign_win_cols, near)
    both = pairs.pair_samples(power, wanted, key=["line_id", "win", "x_win"], values=["p"])
    win = cut_lineage(align.window_shift(both, opt.coalign_max_lag, opt.coalign_upsample, opt.coalign_min_quality))
    cols = wanted.join(slc.select("line_id", "col").distinct(), "line_id")
    return align.shift_profile(win, cols, dt), align.alignment_summary(win)


def network_input(profiles: DataFrame, meta: DataFrame, depth: float = 100.0, max_baseline: float = 10.0) -> DataFrame:
    """Strain of the top `depth` metres per (line, block, pair) with its weight, usable pairs only.

    meta: PAIR and, where known, aligned, coalign_applied, max_baseline. A pair
    without a baseline passes the gate; its weight is its mean coherence, 1e-3 at least.
    """
    ok = meta.where(C.is_aligned(meta.columns) & F.coalesce(F.col("max_baseline") <= max_baseline, F.lit(True))).select(*PAIR)
    p = profiles.join(ok, PAIR, "left_semi")
    v = interp.read_at(p, "depth", "dh", depth, [*PAIR, "block"], out="_dh")
    w = p.groupBy(*PAIR).agg(F.greatest(F.avg("coh"), F.lit(1e-3)).alias("w"))
    return v.join(w, PAIR).select(*PAIR, "block", (F.col("_dh") / depth).alias("d"), "w")


def network_response(pair_values: DataFrame, driver: DataFrame, row: list[str], w: str | None = None, n_sigma: float = 3.0,
                     min_pairs: int = 6, p_value: bool = True, on: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair values through the network, then trend and driver per row.

    driver: epoch (and `on` keys), t, h. Returns (fit, epochs, pair residuals).
    """
    ep, res = network.invert_network(pair_values, row, "ref_idx", "sec_idx", "d", w, n_sigma=n_sigma, min_pairs=min_pairs)
    s = ep.join(driver, [*(on or []), "epoch"])
    return regress.fit_trend_and_driver(s, "x", "t", "h", row, p_value=p_value), ep, res


def depth_response(profile_pairs: DataFrame, driver: DataFrame, row: list[str], orders=(1, 2, 3, 4), norm: float | None = None,
                   min_pairs: int = 6) -> DataFrame:
    """Response of each Legendre coefficient to the driver, per order: fit per pair, network, joint fit.

    profile_pairs: row, ref_idx, sec_idx, z, dh, sd; driver: epoch, h.
    """
    profile_pairs = cut_lineage(profile_pairs)          # read once per order
    out = None
    for o in orders:
        fit = regress.legendre_fit(profile_pairs, "z", "dh", "sd", [*row, "ref_idx", "sec_idx"], order=o, norm=norm, p_value=False)
        c = fit.select(*row, "ref_idx", "sec_idx", F.lit(o).alias("ord"), F.posexplode("coef").alias("k", "d"))
        out = c if out is None else out.unionByName(c)
    drv = driver.withColumn("t", F.col("epoch").cast("double")) if "t" not in driver.columns else driver
    return network_response(out, drv, [*row, "ord", "k"], min_pairs=min_pairs)[0]


def coherent_stack(igram: DataFrame, ref_bins: DataFrame, pass_driver: DataFrame, bins: list[int], kz: Column, block_size: int,
                   grid: list[float], coh_thr: float = 0.3, min_pairs: int = 6, within: list[str] | None = None,
                   tile_width: int | None = None) -> DataFrame:
    """Interferograms to the driver response per (line, block, bin) with its delete-one-pass error.

    pass_driver: line_id, pass_idx, tide_m; passes without a value drop out
    with all their pairs. `kz` may use the column bin.
    """
    f = interferogram.complex_block_mean(igram, ref_bins, block_size, coh_thr, bins, within=within, tile_width=tile_width)
    tide = pass_driver.where("tide_m is not null")
    for side in ("ref", "sec"):                        # block means by now, a few rows per pair
        f = f.join(tide.select("line_id", F.col("pass_idx").alias(f"{side}_idx"), F.col("tide_m").alias(f"_{side}")), ["line_id", f"{side}_idx"])
    f = f.withColumn("dtide", F.col("_sec") - F.col("_ref")).withColumn("kz", kz)
    return coherent.coherent_scan_packed(f, ["line_id", "block", "bin"], F.col("kz"), "dtide", grid, min_pairs)


def modulus(obs: DataFrame, predict: Callable[[DataFrame], DataFrame], e_grid: list[float], x0_grid: list[float],
            keys: list[str] = ["line_id"], refine: bool = True) -> tuple[DataFrame, DataFrame]:
    """Misfit profile and interval over candidates; one nested finer grid places E and x0.

    `predict` takes rows of (observation, candidate E and x0) and adds their `pred`, in
    column expressions. Returns (fit per line, misfit profile on the coarse grid).
    """
    obs = obs.dropna(subset=keys)
    pred = predict(flexure.candidate_grid(obs, e_grid, x0_grid))      # one grid for all lines: unfolded, not joined
    prof = cut_lineage(flexure.profile_misfit(flexure.candidate_misfit(pred, None, keys), keys))
    fit = flexure.modulus_interval(prof, keys)
    if not refine:
        return fit, prof
    e_step = math.log10(e_grid[-1] / e_grid[0]) / (len(e_grid) - 1)
    x_step = (x0_grid[-1] - x0_grid[0]) / max(len(x0_grid) - 1, 1)
    fine = flexure.refine_grid(fit, keys, e_step, x_step, (x0_grid[0], x0_grid[-1]))
    p2 = predict(obs.join(fine, keys))
    best = flexure.profile_misfit(flexure.candidate_misfit(p2, None, keys), keys).where("is_best").select(
        *keys, F.col("E").alias("E_fine"), F.col("x0").alias("x0_fine"), F.col("amp").alias("amp_fine"), F.col("J").alias("J_fine"))
    return fit.join(best, keys), prof
