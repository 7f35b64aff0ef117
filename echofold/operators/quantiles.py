"""Exact order statistics for groups of any size.

Equal values are counted first, the counts are accumulated along the value, and
the rows that hold the wanted ranks are picked; no group is gathered anywhere, and
the formula does not depend on the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.scan import Scan, join_groups, ordered
from echofold.params import MAD_SCALE, ROWS_PER_TILE


def _rank(n: Column, p: float, method: str) -> Column:
    if method == "linear":
        return (n - 1) * F.lit(p)
    if method == "midpoint":
        return F.greatest(F.lit(0.0), F.least(n * F.lit(p) - 0.5, n - 1.0))
    raise ValueError(method)


def quantiles(df: DataFrame, by: list[str], v: str, probs: dict[str, float], method: str = "linear",
              rows: int = ROWS_PER_TILE, bounded: bool = False) -> DataFrame:
    """Exact quantiles of `v` per group, one column per entry of `probs`, and the count n.

    method 'linear' interpolates at (n-1)p, 'midpoint' uses mid-point plotting
    positions n*p - 1/2. Interpolation is between the two neighbouring ranks.
    A caller who knows that groups are small (bounded) gets the built-in percentile.
    """
    ok = df.where(F.col(v).isNotNull())
    if bounded and method == "linear":
        return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(v, F.lit(p)).alias(q) for q, p in probs.items()])
    counts = ok.groupBy(*by, v).agg(F.count(F.lit(1)).alias("_c"))
    spec = [Scan("_upto", F.col("_c"), "sum")]
    upto = ordered(counts, by, v, spec, bounded, rows)
    total = upto.groupBy(*by).agg(F.max("_upto").alias("_n"))
    ranked = join_groups(upto, total, by)
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    picks = []
    for name, p in probs.items():
        h = _rank(F.col("_n"), p, method)
        lo, hi = F.floor(h), F.ceil(h)
        picks += [
            F.max(F.when((first <= lo) & (lo <= last), F.col(v))).alias(f"_{name}_lo"),
            F.max(F.when((first <= hi) & (hi <= last), F.col(v))).alias(f"_{name}_hi"),
            F.max(h - lo).alias(f"_{name}_f"),
        ]
    got = ranked.groupBy(*by).agg(F.max("_n").alias("n"), *picks)
    return got.select(*by, "n", *[
        (F.col(f"_{q}_lo") + F.col(f"_{q}_f") * (F.col(f"_{q}_hi") - F.col(f"_{q}_lo"))).alias(q)
        for q in probs])


def medians(df: DataFrame, by: list[str], v: str, out: str = "med", rows: int = ROWS_PER_TILE,
            bounded: bool = False) -> DataFrame:
    return quantiles(df, by, v, {out: 0.5}, rows=rows, bounded=bounded)


def robust_scale(df: DataFrame, by: list[str], v: str, rows: int = ROWS_PER_TILE, bounded: bool = False) -> DataFrame:
    """Median and scaled MAD about the median per group: columns n, med, sd."""
    ok = df.where(F.col(v).isNotNull()).select(*by, v)
    med = medians(ok, by, v, "med", rows, bounded)
    dev = join_groups(ok, med.select(*by, "med"), by).select(*by, F.abs(F.col(v) - F.col("med")).alias("_dev"))
    mad = medians(dev, by, "_dev", "_mad", rows, bounded).select(*by, "_mad")
    return join_groups(med, mad, by).select(*by, "n", "med", (F.col("_mad") * MAD_SCALE).alias("sd"))
