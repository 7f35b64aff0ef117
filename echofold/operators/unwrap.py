"""Phase to differential delay: reference bin, outward unwrapping, long gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions.columns import wrap
from echofold.operators.scan import TILE, Scan, ordered, settle, spread_over
from echofold.params import ROWS_PER_TILE


def reference_bin(surface: Column, t0: Column, dt: Column, nt: Column, offset: float = 0.0) -> Column:
    """Nearest bin of the surface; NULL, never clamped, where it lies off the axis."""
    pos = (surface + offset - t0) / dt
    return F.when((pos >= 0) & (pos <= nt - 1), F.round(pos).cast("int"))


def steps(df: DataFrame, by: list[str], coh_thr: float, bounded: bool = True, rows: int = ROWS_PER_TILE,
          order: str = "bin") -> DataFrame:
    """Trusted wrapped steps along a trace: `coherent`, `step_ok`, `dphi` (0 where not trusted)."""
    coherent = F.coalesce(F.col("coh") >= coh_thr, F.lit(False))
    d = df.withColumn("coherent", coherent)
    d = ordered(d, by, order, [
        Scan("_pc", F.col("coherent"), "prev"), Scan("_pp", F.col("phase"), "prev")], bounded, rows)
    d = d.withColumn("step_ok", F.coalesce(F.col("coherent") & F.col("_pc"), F.lit(False)))
    return d.withColumn("dphi", F.when(F.col("step_ok"), wrap(F.col("phase") - F.col("_pp"))).otherwise(0.0)
                        ).drop("_pc", "_pp")


def last_valid_bin(stepped: DataFrame, by: list[str], max_gap: int, bounded: bool = True,
                   rows: int = ROWS_PER_TILE, order: str = "bin") -> DataFrame:
    """Attach the last bin before the first run of more than `max_gap` untrusted steps.

    Only steps at or after the reference count. NULL means no such run. The
    order column counts samples without holes.
    """
    stepped, bounded = settle(stepped, by, order, bounded, rows)
    d = ordered(stepped, by, order, [_anchored(order)], bounded, rows)
    d = spread_over(d, by, {"_over": _first_over(order, max_gap)}, bounded)
    return d.withColumn("last_bin", F.col("_over") - max_gap - 1).drop("_good", "_over")


def _anchored(order: str) -> Scan:
    """The last bin that a gap can be counted from."""
    n = F.col(order)
    return Scan("_good", F.when(F.col("step_ok") | (n <= F.col("ref_bin")), n), "last")


def _first_over(order: str, max_gap: int) -> Column:
    """The first bin at which a gap has become too long."""
    n = F.col(order)
    return F.min(F.when((n > F.col("ref_bin")) & (n - F.col("_good") > max_gap), n))


def unwrap_from_reference(df: DataFrame, fc: Column | float, by: list[str], coh_thr: float = 0.3, max_gap: int = 20,
                          sign: int = -1, bounded: bool = True, rows: int = ROWS_PER_TILE,
                          order: str = "bin") -> DataFrame:
    """Differential delay against the reference bin of each trace.

    Needs phase, coh, ref_bin. The trusted steps are summed outward from the
    reference in both directions, which is the running sum minus its value at
    the reference. Adds dtau (at and below the reference), dtau_above_ref and
    valid; all NULL where the trace has no reference.
    """
    fc = F.lit(float(fc)) if not isinstance(fc, Column) else fc
    df, bounded = settle(df, by, order, bounded, rows)
    d = steps(df, by, coh_thr, bounded, rows, order)
    # The sums and the gaps hang on the steps alone, so one scan and one total per trace do for both.
    d = ordered(d, by, order, [Scan("_C", F.col("dphi"), "sum"), _anchored(order)], bounded, rows)
    n, r = F.col(order), F.col("ref_bin")
    d = spread_over(d, by, {"_Cr": F.max(F.when(n == r, F.col("_C"))), "_over": _first_over(order, max_gap)}, bounded)
    d = d.withColumn("last_bin", F.col("_over") - max_gap - 1)
    ok = F.col("coherent") & r.isNotNull() & F.col("_Cr").isNotNull() & (
        F.col("last_bin").isNull() | (n <= F.col("last_bin")))
    tau = F.when(ok, F.lit(float(sign)) * (F.col("_C") - F.col("_Cr")) / (F.lit(2 * math.pi) * fc))
    d = split_above_reference(d.withColumn("_tau", tau), "_tau", order)
    return d.withColumn("valid", F.col("dtau").isNotNull()).drop(
        "_C", "_Cr", "_good", "_over", "_tau", "coherent", "step_ok", "dphi", TILE)


def split_above_reference(df: DataFrame, tau: str, order: str = "bin") -> DataFrame:
    """Values above the reference bin go to their own column."""
    above = F.col(order) < F.col("ref_bin")
    return df.withColumn("dtau", F.when(~above, F.col(tau))).withColumn(
        "dtau_above_ref", F.when(above, F.col(tau)))
