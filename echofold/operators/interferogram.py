"""Pair interferograms: tiled traces, windowed products, coherence, complex block means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.columns import conj_product, finite

COL_TILE = "col_tile"
TRACE = ["line_id", "ref_idx", "sec_idx", "col"]


def tile_columns(slc: DataFrame, width: int = 200, before: int = 7, after: int = 7) -> DataFrame:
    """Spread traces over column tiles, each with the halo its windows need.

    This is the one exchange of raw traces: everything up to the block means
    groups by keys that contain (line_id, col_tile) and stays where it is.
    """
    col = F.col("col")
    tiles = F.sequence(F.greatest(F.floor((col - after) / width), F.lit(0)), F.floor((col + before) / width))
    return slc.withColumn(COL_TILE, F.explode(tiles)).repartition("line_id", COL_TILE)


def explode_samples(pairs: DataFrame) -> DataFrame:
    """Packed pair traces to one row per bin (bin = array position)."""
    names = ["ref_re", "ref_im", "sec_re", "sec_im"]
    keep = [c for c in pairs.columns if c not in names]
    z = pairs.select(*keep, F.posexplode(F.arrays_zip(*names)).alias("bin", "_s"))
    return z.select(*keep, "bin", *[finite(F.col(f"_s.{n}")).alias(n) for n in names])


def _reach(k: int) -> tuple[int, int]:
    """Rows before and after the centre of a boxcar of k, even k leaning forward."""
    k = max(1, round(k))
    return (k - 1) // 2, k // 2


def multilook(samples: DataFrame, win: tuple[int, int] = (5, 15), within: list[str] | None = None) -> DataFrame:
    """Boxcar mean interferogram and coherence over (bins, columns) around every sample.

    `samples` holds one row per (pair, col, bin); missing samples contribute
    nothing and edges are zero-filled. The window is separable: a sum along the
    bins of a trace, then along the columns of a tile. `within` names the tile
    keys under which halo columns were duplicated; see `tile_columns`.
    """
    keys = [*(within or []), "line_id", "ref_idx", "sec_idx"]
    parts = [F.col(c) for c in ("ref_re", "ref_im", "sec_re", "sec_im")]
    good = F.lit(True)
    for p in parts:
        good = good & finite(p).isNotNull()
    rr, ri, sr, si = parts
    re, im = conj_product(sr, si, rr, ri)
    zero = F.lit(0.0)
    x = samples.select(
        *keys, "col", "bin",
        F.when(good, re).otherwise(zero).alias("x_re"), F.when(good, im).otherwise(zero).alias("x_im"),
        F.when(good, rr * rr + ri * ri).otherwise(zero).alias("p_ref"),
        F.when(good, sr * sr + si * si).otherwise(zero).alias("p_sec"),
        good.cast("double").alias("cnt"))
    fields = ["x_re", "x_im", "p_ref", "p_sec", "cnt"]
    for axis, other, k in (("bin", "col", win[0]), ("col", "bin", win[1])):
        lo, hi = _reach(k)
        w = Window.partitionBy(*keys, other).orderBy(F.col(axis).cast("long")).rangeBetween(-lo, hi)
        x = x.select(*keys, "col", "bin", *[F.sum(f).over(w).alias(f) for f in fields])
    den = F.sqrt(F.col("p_ref") * F.col("p_sec"))
    mag = F.sqrt(F.col("x_re") * F.col("x_re") + F.col("x_im") * F.col("x_im"))
    cnt = F.when(F.col("cnt") >= 1, F.col("cnt"))
    return x.select(*keys, "col", "bin", (F.col("x_re") / cnt).alias("re"), (F.col("x_im") / cnt).alias("im"),
                    F.when(den > 0, F.least(mag / den, F.lit(1.0))).otherwise(zero).alias("coh"))


def drop_halo(df: DataFrame, width: int = 200) -> DataFrame:
    """Keep each column only in its own tile."""
    return df.where(F.floor(F.col("col") / width) == F.col(COL_TILE))


def tile_table(table: DataFrame, width: int, values: list[str], aggs: dict[str, Column] | None = None) -> DataFrame:
    """Per-column values packed by column tile: one array per value, by position in the tile."""
    at = F.col("col") - F.floor(F.col("col") / width) * width
    packed = table.groupBy("line_id", F.floor(F.col("col") / width).alias(COL_TILE)).agg(
        F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("k"), F.struct(*values).alias("v")))).alias("_m"),
        *[a.alias(n) for n, a in (aggs or {}).items()])
    slots = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at("_m", i))
    return packed.withColumn("_slots", slots).drop("_m")


def attach_by_tile(samples: DataFrame, tiles: DataFrame, width: int, values: list[str]) -> DataFrame:
    """Per-column values onto tiled samples by a join on exactly (line_id, col_tile).

    The samples are partitioned by these two keys already, so only the small
    table moves; a join on the column itself would shuffle every sample.
    """
    d = samples.join(tiles, ["line_id", COL_TILE], "left")
    slot = F.get("_slots", (F.col("col") - F.col(COL_TILE) * width).cast("int"))
    return d.select(*[c for c in d.columns if c != "_slots"], *[slot[v].alias(v) for v in values])


def complex_block_mean(igram: DataFrame, ref_bins: DataFrame, block_size: int, coh_thr: float = 0.3,
                       bins: list[int] | None = None, unit: bool = False,
                       within: list[str] | None = None, tile_width: int | None = None) -> DataFrame:
    """Coherence-weighted complex mean per (pair, block, bin), phase relative to the reference bin.

    Each column is turned by the unit conjugate of its own sample at its
    reference bin; a column without one weighs nothing. `unit` strips the
    modulus first, and the modulus of the mean is then the phase concentration.
    With `tile_width` the samples are in column tiles (no halo left) and stay there.
    """
    keys = [*(within or []), "line_id", "ref_idx", "sec_idx"]
    trace = Window.partitionBy(*keys, "col")
    if tile_width:
        g = attach_by_tile(igram, tile_table(ref_bins, tile_width, ["ref_bin"]), tile_width, ["ref_bin"])
    else:
        g = igram.join(ref_bins.select("line_id", "col", "ref_bin"), ["line_id", "col"], "left")
    at_ref = F.col("bin") == F.col("ref_bin")
    for c in ("re", "im"):
        g = g.withColumn(f"_r{c}", F.max(F.when(at_ref, F.col(c))).over(trace))
    if bins is not None:
        g = g.where(F.col("bin").isin(list(bins)))
    mag = F.sqrt(F.col("_rre") * F.col("_rre") + F.col("_rim") * F.col("_rim"))
    has = F.coalesce(mag > 2.220446049250313e-16, F.lit(False))
    u, v = F.col("_rre") / mag, F.col("_rim") / mag
    re, im = conj_product(F.col("re"), F.col("im"), u, v)
    if unit:
        own = F.nullif(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.lit(0.0))
        re, im = re / own, im / own
    w = F.when(has & (F.col("coh") >= coh_thr), F.col("coh")).otherwise(F.lit(0.0))
    g = g.select("line_id", "ref_idx", "sec_idx", F.floor(F.col("col") / block_size).alias("block"), "bin",
                 w.alias("w"), F.when(has, F.coalesce(re, F.lit(0.0))).otherwise(0.0).alias("_re"),
                 F.when(has, F.coalesce(im, F.lit(0.0))).otherwise(0.0).alias("_im"))
    s = g.groupBy("line_id", "ref_idx", "sec_idx", "block", "bin").agg(
        F.sum(F.col("_re") * F.col("w")).alias("_sr"), F.sum(F.col("_im") * F.col("w")).alias("_si"),
        F.sum("w").alias("w"))
    den = F.greatest(F.col("w"), F.lit(2.220446049250313e-16))
    return s.select("line_id", "ref_idx", "sec_idx", "block", "bin",
                    (F.col("_sr") / den).alias("re"), (F.col("_si") / den).alias("im"), "w")
