"""Passes, pairs, baselines and repeat intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.operators.interp import interp_join

PAIR = ["line_id", "ref_idx", "sec_idx"]


def pass_slice_map(passes: DataFrame, main_idx: Column | int = 1, n_slices: DataFrame | None = None) -> DataFrame:
    """Enabled passes get image slices 1..n in pass order; `is_main` marks the main pass.

    A mask shorter than the pass list leaves the rest enabled (NULL = enabled).
    A disabled or absent main pass, or an image count that differs from the
    number of enabled passes, raises when the rows are read. A line has a
    handful of passes, so its window is small.
    """
    main = F.lit(main_idx) if isinstance(main_idx, int) else main_idx
    on = F.coalesce(F.col("enabled"), F.lit(True))
    w = Window.partitionBy("line_id").orderBy("pass_idx")
    line = Window.partitionBy("line_id")
    out = passes.select("line_id", "pass_idx", on.alias("enabled"), main.alias("_main"))
    out = out.withColumn("slice_idx", F.when(F.col("enabled"), F.sum(F.col("enabled").cast("int")).over(w)))
    out = out.withColumn("is_main", F.col("pass_idx") == F.col("_main"))
    main_ok = F.max((F.col("is_main") & F.col("enabled")).cast("int")).over(line) == 1
    out = out.withColumn("_bad", F.when(main_ok, F.lit(False)).otherwise(
        F.raise_error("main pass is absent or disabled").cast("boolean")))
    if n_slices is not None:
        out = out.join(n_slices, "line_id", "left")
        n_on = F.sum(F.col("enabled").cast("int")).over(line)
        out = out.withColumn("_bad", F.when(n_on == F.col("n_slices"), F.col("_bad")).otherwise(
            F.raise_error("enabled passes and images differ in number").cast("boolean")))
    return out.where(~F.col("_bad")).select("line_id", "pass_idx", "slice_idx", "is_main")


def make_pairs(passes: DataFrame, mode: str | DataFrame = "all", main_idx: Column | None = None) -> DataFrame:
    """Pairs (line_id, ref_idx, sec_idx) among the enabled passes.

    'main': the main pass with every other one; 'sequential': consecutive
    enabled passes; 'all': every i < j; a DataFrame: the wanted pairs, minus
    those naming a disabled pass and self-pairs. Passes per line are few by
    construction (one row per traverse); pairs never cross lines.
    """
    on = passes.where(F.coalesce(F.col("enabled"), F.lit(True))) if "enabled" in passes.columns else passes
    if isinstance(mode, DataFrame):
        a = on.select("line_id", F.col("pass_idx").alias("ref_idx"))
        b = on.select("line_id", F.col("pass_idx").alias("sec_idx"))
        return (mode.select(*PAIR).join(a, ["line_id", "ref_idx"], "left_semi")
                .join(b, ["line_id", "sec_idx"], "left_semi")
                .where("ref_idx <> sec_idx").select(*PAIR))
    ref = on.select("line_id", F.col("pass_idx").alias("ref_idx"))
    sec = on.select("line_id", F.col("pass_idx").alias("sec_idx"))
    if mode == "sequential":
        w = Window.partitionBy("line_id").orderBy("pass_idx")
        return on.select("line_id", F.col("pass_idx").alias("ref_idx"),
                         F.lead("pass_idx").over(w).alias("sec_idx")).where("sec_idx is not null")
    if mode == "main":
        if main_idx is None:
            main = on.groupBy("line_id").agg(F.min("pass_idx").alias("ref_idx"))
        else:
            main = on.where(F.col("pass_idx") == main_idx).select("line_id", F.col("pass_idx").alias("ref_idx"))
        return main.join(sec, "line_id").where("sec_idx <> ref_idx").select(*PAIR)
    if mode == "all":
        return ref.join(sec, "line_id").where("ref_idx < sec_idx").select(*PAIR)
    raise ValueError(f"unknown pair mode {mode!r}")


def pair_samples(slc: DataFrame, pairs: DataFrame | None = None, key: list[str] | None = None,
                 values: list[str] | None = None, mode: str = "all", main_idx: int | None = None) -> DataFrame:
    """Reference and second trace of every pair, formed where the traces of a column meet.

    All passes of one (line, column) are gathered into a short array, a bounded
    group of one trace per pass, and the pairs are unfolded inside the row: the
    traces are shuffled once, not once per pair as in a self-join.
    """
    key = key or ["line_id", "col"]
    values = values or ["re", "im"]
    packed = slc.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("pass_idx", *values))).alias("_t"))
    n = F.size("_t")
    a = packed.select(*key, "_t", F.posexplode("_t").alias("_i", "_a"))
    if mode == "sequential":
        a = a.where(F.col("_i") + 1 < n).withColumn("_b", F.col("_t")[F.col("_i") + 1])
    elif mode == "main":
        main = F.lit(main_idx) if main_idx is not None else F.col("_t")[0]["pass_idx"]
        a = a.where(F.col("_a.pass_idx") == main).withColumn(
            "_b", F.explode(F.filter("_t", lambda x: x["pass_idx"] != F.col("_a.pass_idx"))))
    else:
        a = a.where(F.col("_i") + 1 < n).withColumn(
            "_b", F.explode(F.slice("_t", F.col("_i") + 2, n - F.col("_i") - 1)))
    out = a.select(*key, F.col("_a.pass_idx").alias("ref_idx"), F.col("_b.pass_idx").alias("sec_idx"),
                   *[F.col(f"_a.{v}").alias(f"ref_{v}") for v in values],
                   *[F.col(f"_b.{v}").alias(f"sec_{v}") for v in values])
    if pairs is not None:
        # A line has at most its passes squared pairs; a list too long to travel is met by a shuffled join.
        out = out.join(pairs.select(*PAIR), PAIR, "left_semi")
    return out


def pair_baseline(tracks: DataFrame, pairs: DataFrame, fld: str = "ref_y") -> DataFrame:
    """Per column, second minus reference of one track field: (pair, col, baseline)."""
    t = pair_samples(tracks.select("line_id", "pass_idx", "col", fld), pairs, values=[fld])
    return t.select(*PAIR, "col", (F.col(f"sec_{fld}") - F.col(f"ref_{fld}")).alias("baseline"))


def baseline_gate(pairs: DataFrame, baseline: DataFrame, max_m: float = 10.0) -> DataFrame:
    """Largest |baseline| per pair and whether it passes; a pair without one passes."""
    worst = baseline.groupBy(*PAIR).agg(F.max(F.abs("baseline")).alias("max_baseline"))
    return pairs.join(worst, PAIR, "left").withColumn(
        "keep", F.coalesce(F.col("max_baseline") <= max_m, F.lit(True)))


def times_on_main(tracks: DataFrame, main: DataFrame) -> DataFrame:
    """Every pass's time at the main pass's column positions (end segments prolonged).

    `main` holds (line_id, col, along_m); a one-point pass keeps its mean time.
    A pass has about as many fixes as the line has columns, so it fits a window.
    """
    passes = tracks.select("line_id", "pass_idx").distinct()
    at = main.select("line_id", "col", "along_m").join(passes, "line_id")
    return interp_join(at, tracks.select("line_id", "pass_idx", "along_m", "gps_time_s"), "along_m", "gps_time_s",
                       by=["line_id", "pass_idx"], policy="extrap", bounded=True)


def repeat_interval(tracks: DataFrame, pairs: DataFrame, main: DataFrame) -> DataFrame:
    """Per column, second minus reference time on the main axis: (pair, col, dt_s)."""
    t = times_on_main(tracks, main)
    both = pair_samples(t.select("line_id", "pass_idx", "col", "gps_time_s"), pairs, values=["gps_time_s"])
    return both.select(*PAIR, "col", (F.col("sec_gps_time_s") - F.col("ref_gps_time_s")).alias("dt_s"))


def drop_flagged(pairs: DataFrame, bad: DataFrame) -> DataFrame:
    """Remove every pair that touches a flagged (line_id, pass_idx)."""
    r = bad.select("line_id", F.col("pass_idx").alias("ref_idx"))
    s = bad.select("line_id", F.col("pass_idx").alias("sec_idx"))
    return pairs.join(r, ["line_id", "ref_idx"], "left_anti").join(s, ["line_id", "sec_idx"], "left_anti").select(
        *pairs.columns)


def auto_flagged(quality: DataFrame, quality_floor: float = 0.85, min_applied: float = 0.5) -> DataFrame:
    """Passes whose median alignment quality or applied fraction is too low."""
    return quality.where((F.col("q_med") < quality_floor) | (F.col("frac_applied") < min_applied)).select(
        "line_id", "pass_idx")


def dominant_reference(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Most frequent reference pass per group, the smallest on ties."""
    by = by or ["line_id"]
    n = pairs.groupBy(*by, "ref_idx").agg(F.count(F.lit(1)).alias("n_pairs"))
    best = F.max(F.struct(F.col("n_pairs"), (-F.col("ref_idx")).alias("m")))
    return n.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.m")).alias("ref_idx"), F.col("b.n_pairs").alias("n_pairs"))
