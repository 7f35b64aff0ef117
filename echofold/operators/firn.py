"""Density column, traveltime to depth, delay to displacement and velocity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.operators.interp import interp_lookup
from echofold.operators.scan import TILE, Scan, ordered, settle
from echofold.params import C_LIGHT, EPS_ICE, KOVACS_A, RHO_ICE, ROWS_PER_TILE, SEC_PER_YEAR, FirnParams


def density(d: Column, p: FirnParams) -> Column:
    """Relative density: logistic between surface and close-off, at most 1."""
    beta = math.log(1 / p.rho_sfc - 1)
    slope = math.log(1 / p.rho_bco - 1) - beta
    return F.least(1.0 / (1.0 + F.exp(beta + slope * d / p.bco_depth)), F.lit(1.0))


def index_of(rho: Column, p: FirnParams) -> Column:
    """Refractive index from relative density, linear or cube-root mixing."""
    if p.mixing == "kovacs":
        return 1.0 + KOVACS_A * rho * (RHO_ICE / 1000)
    return F.pow(1.0 + rho * (EPS_ICE ** (1 / 3) - 1), F.lit(1.5))


def running_trapezoid(df: DataFrame, x: str, y: str, by: list[str], out: str = "integral",
                      rows: int = ROWS_PER_TILE, bounded: bool = False) -> DataFrame:
    """Cumulative trapezoid of y over x, 0 at the first point of each group."""
    d, bounded = settle(df, by, x, bounded, rows)
    d = ordered(d, by, x, [Scan("_px", F.col(x), "prev"), Scan("_py", F.col(y), "prev")], bounded, rows)
    d = d.withColumn("_area", F.coalesce((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / 2, F.lit(0.0)))
    return ordered(d, by, x, [Scan(out, F.col("_area"), "sum")], bounded, rows).drop("_px", "_py", "_area", TILE)


def firn_table(spark: SparkSession, p: FirnParams = FirnParams(), rate: float | None = None) -> DataFrame:
    """Depth table (d, rho, n, twtt), p.nz rows; with `rate` also the densification integral.

    The table has a row count set by its parameters, so its one running sum is
    a plain window over that many rows.
    """
    step = p.max_depth / (p.nz - 1)
    t = spark.range(p.nz).select((F.col("id") * step).alias("d"))
    t = t.withColumn("rho", density(F.col("d"), p)).withColumn("n", index_of(F.col("rho"), p))
    t = t.withColumn("_k", F.lit(0))
    t = _short_trapezoid(t, "d", "n", "_opt").withColumn("twtt", F.col("_opt") * (2 / C_LIGHT)).drop("_opt")
    if rate is not None:
        if p.mixing == "kovacs":
            dn = F.lit(KOVACS_A * RHO_ICE / 1000)
        else:
            k = EPS_ICE ** (1 / 3) - 1
            dn = 1.5 * k * F.sqrt(1.0 + F.col("rho") * k)
        taper = F.greatest(F.lit(0.0), 1.0 - F.col("d") / p.bco_depth)
        t = t.withColumn("_g", dn * rate * taper)
        t = _short_trapezoid(t, "d", "_g", "densify").drop("_g")
    return t.drop("_k")


def _short_trapezoid(t: DataFrame, x: str, y: str, out: str) -> DataFrame:
    w = Window.partitionBy("_k").orderBy(x)
    t = t.withColumn("_area", F.coalesce((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2, F.lit(0.0)))
    return t.withColumn(out, F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_area")


def _twtt_max(p: FirnParams) -> float:
    """Traveltime of the last table row, by the same trapezoid rule."""
    beta = math.log(1 / p.rho_sfc - 1)
    slope = math.log(1 / p.rho_bco - 1) - beta
    step, total, before = p.max_depth / (p.nz - 1), 0.0, None
    for k in range(p.nz):
        rho = min(1 / (1 + math.exp(beta + slope * k * step / p.bco_depth)), 1.0)
        n = 1 + KOVACS_A * rho * RHO_ICE / 1000 if p.mixing == "kovacs" else (1 + rho * (EPS_ICE ** (1 / 3) - 1)) ** 1.5
        total += 0.0 if before is None else step * (n + before) / 2
        before = n
    return total * 2 / C_LIGHT


def depth_from_twtt(df: DataFrame, twtt: Column, firn: DataFrame, p: FirnParams = FirnParams()) -> DataFrame:
    """Add depth and the local index at a traveltime below the surface; NULL off the table."""
    out = interp_lookup(df, firn, twtt, "twtt", {"d": "depth"}, 0.0, _twtt_max(p), p.nz)
    return interp_lookup(out, firn, F.col("depth"), "d", {"n": "n_local"}, 0.0, p.max_depth, p.nz)


def geometric_dh(dtau: Column, n_local: Column) -> Column:
    """Displacement of a delay at the local index."""
    return dtau * (C_LIGHT / 2) / n_local


def to_displacement(blocks: DataFrame, twtt: Column, firn: DataFrame, p: FirnParams = FirnParams()) -> DataFrame:
    """Depth, local index and dh, dh_std, dh_scatter of block delays (mean, std, scatter)."""
    d = depth_from_twtt(blocks, twtt, firn, p)
    return d.select("*", *[geometric_dh(F.col(a), F.col("n_local")).alias(b) for a, b in (
        ("mean", "dh"), ("std", "dh_std"), ("scatter", "dh_scatter"))])


def densification_correction(df: DataFrame, firn: DataFrame, dt_years: Column,
                             p: FirnParams = FirnParams()) -> DataFrame:
    """Take the apparent motion of densifying firn out of dh (needs firn_table(rate=...))."""
    d = interp_lookup(df, firn, F.col("depth"), "d", {"densify": "_g"}, 0.0, p.max_depth, p.nz)
    tau = (2 / C_LIGHT) * F.col("_g") * dt_years
    return d.withColumn("dh", F.col("dh") - geometric_dh(tau, F.col("n_local"))).drop("_g")


def to_velocity(df: DataFrame, intervals: DataFrame, on: list[str]) -> DataFrame:
    """Divide by each block's own interval (dt_s); errors by its magnitude."""
    yr = F.col("dt_s") / SEC_PER_YEAR
    yr = F.nullif(yr, F.lit(0.0))
    d = df.join(intervals.select(*on, "dt_s"), on)
    return d.select("*", (F.col("dh") / yr).alias("v"), (F.col("dh_std") / F.abs(yr)).alias("v_std"),
                    (F.col("dh_scatter") / F.abs(yr)).alias("v_scatter"))


def expected_curves(depths: DataFrame, thickness: float, flex_len: float, nu: float, acc: float, bco: float,
                    rho_surf: float, span_days: float) -> DataFrame:
    """Reference curves against depth: plate bending per metre of tide, and firn compaction (mm)."""
    d = F.col("depth")
    surf = (thickness / 2) / flex_len ** 2
    bend = F.lit(1e3 * (-nu / (1 - nu)) * surf) * (1 - d / thickness) * d
    rate = acc * (RHO_ICE / rho_surf - 1)
    comp = F.lit(-1e3 * rate * span_days / 365.25) * F.least(d / bco, F.lit(1.0))
    return depths.select("*", bend.alias("tide_mm"), comp.alias("secular_mm"))


def const_index_to_true_depth(df: DataFrame, z: str, firn: DataFrame, p: FirnParams, er: float = 3.18) -> DataFrame:
    """Constant-permittivity range to depth in the firn column; table ends are held."""
    table = firn.select((F.col("twtt") * (C_LIGHT / (2 * math.sqrt(er)))).alias("z_const"), F.col("d").alias("true_depth"))
    hi = _twtt_max(p) * C_LIGHT / (2 * math.sqrt(er))
    held = F.greatest(F.lit(0.0), F.least(F.col(z), F.lit(hi)))
    return interp_lookup(df, table, held, "z_const", {"true_depth": "true_depth"}, 0.0, hi, p.nz)
