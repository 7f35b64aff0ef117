"""Block averages and weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions.columns import safe_div
from echofold.operators.scan import spread_over

EPS = 2.220446049250313e-16


def block_average(df: DataFrame, by: list[str], block: Column, n_cols: Column, value: str = "dtau", coh: str = "coh",
                  coh_thr: float = 0.3, min_coverage: float = 0.3, cols_per_look: int = 15,
                  within: list[str] | None = None, bounded: bool = True) -> DataFrame:
    """Coherence-weighted block mean with scatter, Kish sample size and error.

    `by` is the row of the output besides the block (pair and bin), `n_cols`
    the number of columns the block spans. The second moment is taken about the
    mean, so nothing cancels. A block row is bounded by the block size, so its
    mean is attached by a window: one exchange, none at all when `within` names
    the tile keys the samples already share. Where blocks may hold any number
    of samples, bounded=False sums them map-side first.
    """
    keys = [*(within or []), *by, "block"]
    w = F.when(F.col(value).isNotNull() & (F.col(coh) >= coh_thr), F.col(coh)).otherwise(F.lit(0.0))
    s = df.withColumn("block", block).withColumn("_n", n_cols).select(
        *keys, "_n", w.alias("_w"), F.coalesce(F.col(value), F.lit(0.0)).alias("_d"), F.col(coh).alias("_coh"))
    s = spread_over(s, keys, {"_a": F.sum("_w"), "_b": F.sum(F.col("_w") * F.col("_d"))}, bounded)
    s = s.withColumn("_mu", F.col("_b") / F.greatest(F.col("_a"), F.lit(EPS)))
    dev = F.col("_d") - F.col("_mu")
    g = s.groupBy(*keys).agg(
        F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_w")).alias("sw2"), F.first("_mu").alias("_mu"),
        F.sum(F.col("_w") * dev * dev).alias("_m2"), F.sum((F.col("_w") > 0).cast("long")).alias("_used"),
        F.avg(F.when(F.col("_w") > 0, F.col("_coh"))).alias("_mc"), F.max("_n").alias("_n"))
    cover = F.col("_used") / F.col("_n")
    keep = (F.col("sw") > 0) & (cover >= min_coverage)
    sd = F.sqrt(F.col("_m2") / F.greatest(F.col("sw"), F.lit(EPS)))
    n_eff = F.greatest(F.col("sw") * F.col("sw") / F.greatest(F.col("sw2"), F.lit(EPS)) / cols_per_look, F.lit(1.0))
    return g.select(*by, "block", cover.alias("coverage"), *[
        F.when(keep, e).alias(n) for n, e in (
            ("mean", F.col("_mu")), ("scatter", sd), ("n_eff", n_eff), ("std", sd / F.sqrt(n_eff)),
            ("coh", F.col("_mc")))])


def block_geolocation(tracks: DataFrame, by: list[str], block_size: int, fields: list[str]) -> DataFrame:
    """Plain block means of the track fields, missing values skipped."""
    return tracks.groupBy(*by, F.floor(F.col("col") / block_size).alias("block")).agg(
        *[F.avg(f).alias(f) for f in fields])


def inverse_variance_mean(df: DataFrame, v: str, s: str, by: list[str], inflate: float = 1.0) -> DataFrame:
    """Mean weighted by 1/s^2; error is the larger of the formal and the scatter one.

    Rows without a positive sigma do not count; fewer than two leave no mean.
    """
    sig = F.col(s) * inflate
    ok = df.where(F.col(v).isNotNull() & (F.col(s) > 0)).withColumn("_w", 1.0 / (sig * sig))
    g = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col(v)).alias("_swv"),
        F.stddev_samp(v).alias("_sd"))
    formal, scat = F.sqrt(1.0 / F.col("_sw")), F.col("_sd") / F.sqrt(F.col("n"))
    return g.where("n >= 2").select(
        *by, "n", (F.col("_swv") / F.col("_sw")).alias("mean"), formal.alias("formal"), scat.alias("scatter"),
        F.greatest(formal, scat).alias("err"))


def stack_bins(df: DataFrame, x: str, v: str, s: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Inverse-variance stack in left-closed bins of `width`; at least two members."""
    by = by or []
    ok = df.where(F.col(v).isNotNull() & (F.col(s) > 0) & F.col(x).isNotNull())
    q = 1.0 / (F.col(s) * F.col(s))
    g = ok.groupBy(*by, F.floor(F.col(x) / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("_q"), F.sum(q * F.col(v)).alias("_qv"))
    return g.where("n >= 2").select(*by, "bin", ((F.col("bin") + 0.5) * width).alias("centre"), "n",
                                    (F.col("_qv") / F.col("_q")).alias("mean"), F.sqrt(1.0 / F.col("_q")).alias("std"))


def value_at(binned: DataFrame, x0: float, width: float, by: list[str] | None = None) -> DataFrame:
    """Stacked value at a position: between bin centres, else its own bin, else none; `how` says which."""
    by = by or []
    pt = F.struct(F.col("centre").alias("x"), F.col("mean").alias("v"), F.col("std").alias("e"))
    near = F.struct(F.abs(F.col("centre") - x0).alias("gap"), F.col("centre").alias("x"), F.col("mean").alias("v"),
                    F.col("std").alias("e"))
    g = binned.groupBy(*by).agg(
        F.max(F.when(F.col("centre") <= x0, pt)).alias("a"), F.min(F.when(F.col("centre") >= x0, pt)).alias("b"),
        F.min(near).alias("c"), F.count(F.lit(1)).alias("_n"))
    f = F.coalesce(safe_div(F.lit(x0) - F.col("a.x"), F.col("b.x") - F.col("a.x")), F.lit(0.0))
    inside = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("_n") >= 2)
    own = F.col("c.gap") <= width / 2
    blend = lambda k: F.when(inside, F.col(f"a.{k}") + f * (F.col(f"b.{k}") - F.col(f"a.{k}"))).when(own, F.col(f"c.{k}"))
    return g.select(*by, blend("v").alias("v"), blend("e").alias("e"),
                    F.when(inside, "interpolated").when(own, "own bin").otherwise("none").alias("how"))


def zone_depth_mean(df: DataFrame, by: list[str], v: str, sd: str) -> DataFrame:
    """Inverse-variance mean and its formal error per zone and depth, single members included."""
    ok = df.where(F.col(v).isNotNull() & (F.col(sd) > 0))
    w = 1.0 / (F.col(sd) * F.col(sd))
    return ok.groupBy(*by).agg((F.sum(w * F.col(v)) / F.sum(w)).alias("mean"), (1.0 / F.sqrt(F.sum(w))).alias("err"))
