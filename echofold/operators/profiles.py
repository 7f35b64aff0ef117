"""Profiles along the line and in depth: change points, kernels, slices, sections, layers."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.columns import db, power, safe_div
from echofold.operators.quantiles import medians
from echofold.operators.scan import Scan, join_groups, moving, ordered, rows_around, spread_over
from echofold.params import ROWS_PER_TILE
from echofold.session import cut_lineage

#: Columns of a tile of a section, and how many tiles' maps are put together at a time.
LAYER_COLUMNS, FOLD = 256, 256


def change_point(df: DataFrame, x: str, v: str, by: list[str], min_side: int = 3, min_contrast: float = 0.5, sign: int = 1,
                 keep: list[str] = (), rows: int = ROWS_PER_TILE) -> DataFrame:
    """Split with the largest drop (sign=1) or rise (sign=-1) of the mean, the first on ties.

    At least min_side samples on either side and a contrast of min_contrast;
    the position, and each of `keep`, is midway between the two samples at the
    split. Means come from running sums, so every split costs one row.
    """
    fields = [x, *keep]
    d = df.where(F.col(v).isNotNull() & F.col(x).isNotNull())
    d = ordered(d, by, x, [Scan("_k", F.lit(1).cast("long"), "sum"), Scan("_s", F.col(v), "sum"),
                           Scan("_nx", F.struct(*fields), "follow")], rows=rows)
    tot = d.groupBy(*by).agg(F.max("_k").alias("_n"), F.sum(v).alias("_t"))
    d = join_groups(d, tot, by).where((F.col("_k") >= min_side) & (F.col("_k") <= F.col("_n") - min_side))
    c = sign * (F.col("_s") / F.col("_k") - (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_k")))
    mids = [((F.col(f) + F.col(f"_nx.{f}")) / 2).alias(f) for f in fields]
    best = d.groupBy(*by).agg(F.max(F.struct(c.alias("contrast"), (-F.col("_k")).alias("m"), *mids)).alias("b"))
    return best.where(F.col("b.contrast") >= min_contrast).select(
        *by, F.col("b.contrast").alias("contrast"), (-F.col("b.m")).alias("k"), *[F.col(f"b.{f}").alias(f) for f in fields])


def kernel_profile(df: DataFrame, x: str, v: str, s: str, width: float, step: float, min_n: int, by: list[str]) -> DataFrame:
    """Tricube x inverse-variance local mean on a regular grid, with its error.

    The grid starts at each group's first usable position. A sample knows which
    grid points it reaches, so it is unfolded onto those and summed map-side.
    """
    ok = df.where(F.col(x).isNotNull() & F.col(v).isNotNull() & (F.col(s) > 0))
    ends = ok.groupBy(*by).agg(F.min(x).cast("double").alias("_x0"), F.max(x).cast("double").alias("_x1"))
    half = width / 2
    rel = F.col(x) - F.col("_x0")
    last = F.floor((F.col("_x1") - F.col("_x0")) / step)
    lo = F.greatest(F.lit(0), F.ceil((rel - half) / step))
    hi = F.least(last, F.floor((rel + half) / step))
    d = ok.join(ends, by).withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    d = d.withColumn("k", F.explode(F.sequence("_lo", "_hi"))).withColumn("xg", F.col("_x0") + F.col("k") * step)
    u = F.abs(F.col(x) - F.col("xg")) / half
    d = d.withColumn("_u", u).where("_u < 1")
    w = F.pow(1 - F.pow(F.col("_u"), F.lit(3.0)), F.lit(3.0)) / (F.col(s) * F.col(s))
    d = d.withColumn("_w", w)
    g = d.groupBy(*by, "k").agg(
        F.first("xg").alias("xg"), F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col(v)).alias("_swv"),
        F.sum(F.col("_w") * F.col("_w") * F.col(s) * F.col(s)).alias("_e"))
    return g.where((F.col("n") >= min_n) & (F.col("_sw") > 0)).select(
        *by, "k", "xg", "n", (F.col("_swv") / F.col("_sw")).alias("mean"), (F.sqrt("_e") / F.col("_sw")).alias("err"))


def depth_gradient(df: DataFrame, z: str, v: str, by: list[str], smooth: int = 5, rows: int = ROWS_PER_TILE) -> DataFrame:
    """Difference over the depth step of the moving mean; the deepest row has none."""
    before, after = _centred(smooth)
    d = rows_around(df, by, z, {"_m": F.avg(v)}, before, after, rows)
    d = ordered(d, by, z, [Scan("_nm", F.col("_m"), "follow"), Scan("_nz", F.col(z), "follow")], rows=rows)
    return d.select(*by, z, F.col("_m").alias("smooth"), safe_div(F.col("_nm") - F.col("_m"), (F.col("_nz") - F.col(z)).cast("double")).alias("gradient"))


def _centred(k: int) -> tuple[int, int]:
    """Rows before and after for a centred window of k; even k leans back."""
    return (k // 2, k // 2 if k % 2 else k // 2 - 1)


def slice_strain(profiles: DataFrame, z: str, dh: str, by: list[str], intervals: list[tuple[float, float]], min_n: int = 4) -> DataFrame:
    """(dh(b) - dh(a)) / (b - a) per depth interval; a = 0 means dh = 0 there.

    All interval ends are read in the same aggregation.
    """
    ok = F.col(z).isNotNull() & F.col(dh).isNotNull()
    pt = F.struct(F.col(z).cast("double").alias("x"), F.col(dh).cast("double").alias("v"))
    ends = sorted({e for ab in intervals for e in ab if e != 0})
    name = {e: f"_e{k}" for k, e in enumerate(ends)}
    aggs = [F.count(F.when(ok, 1)).alias("_n")]
    for e in ends:
        aggs += [F.max(F.when(ok & (F.col(z) <= e), pt)).alias(name[e] + "a"), F.min(F.when(ok & (F.col(z) >= e), pt)).alias(name[e] + "b")]
    g = profiles.groupBy(*by).agg(*aggs).where(F.col("_n") >= min_n)

    def value(e: float) -> Column:
        a, b = F.col(name[e] + "a"), F.col(name[e] + "b")
        line = F.when(a["x"] == b["x"], a["v"]).otherwise(a["v"] + safe_div((e - a["x"]) * (b["v"] - a["v"]), b["x"] - a["x"]))
        return F.when(a.isNotNull() & b.isNotNull(), line)

    items = [F.struct(F.lit(float(a)).alias("top"), F.lit(float(b)).alias("bottom"),
                      ((value(b) - (value(a) if a != 0 else F.lit(0.0))) / (b - a)).alias("strain")) for a, b in intervals]
    return g.select(*by, F.explode(F.array(*items)).alias("s")).select(*by, "s.top", "s.bottom", "s.strain")


def sign_change(slices: DataFrame, by: list[str], z: str, v: str) -> DataFrame:
    """First and last depth midway between consecutive slices of opposite sign.

    A profile has a few slices, so the plain window is enough. A missing slice
    separates its neighbours.
    """
    w = Window.partitionBy(*by).orderBy(z)
    d = slices.withColumn("_pv", F.lag(v).over(w)).withColumn("_pz", F.lag(z).over(w))
    flip = F.when(F.col(v).isNotNull() & F.col("_pv").isNotNull() & (F.signum(v) != F.signum("_pv")), (F.col(z) + F.col("_pz")) / 2)
    g = d.groupBy(*by).agg(F.min(flip).alias("first_change"), F.max(flip).alias("last_change"))
    return g.where("first_change is not null")


def boxcar_mean(df: DataFrame, by: list[str], axes: list[tuple[str, int]], v: str, out: str) -> DataFrame:
    """Moving means along integer axes one after the other; missing values skipped, edges shrink."""
    cols = [a for a, _ in axes]
    d, src = df, v
    for axis, k in axes:
        before, after = _centred(k)
        others = [c for c in cols if c != axis]
        d = moving(d, [*by, *others], axis, {"_new": F.avg(src)}, before, after)
        d = (d.drop(out) if out in d.columns else d).withColumnRenamed("_new", out)
        src = out
    return d


def _sliding_median(values: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Median of the values from `before` rows back to `after` ahead of each row in `at` (rising), NaN skipped, from one sorted buffer."""
    held, out, lo, hi = [], np.full(len(at), np.nan), 0, 0
    for k, i in enumerate(at):
        for j in range(hi, min(i + after + 1, len(values))):
            if values[j] == values[j]:
                insort(held, values[j])
        hi = max(hi, min(i + after + 1, len(values)))
        for j in range(lo, max(i - before, 0)):
            if values[j] == values[j]:
                del held[bisect_left(held, values[j])]
        lo = max(lo, i - before, 0)
        if held:
            m = len(held)
            out[k] = (held[(m - 1) // 2] + held[m // 2]) / 2
    return out


def moving_median(df: DataFrame, by: list[str], order: str, v: str, k: int, out: str = "med", rows: int = ROWS_PER_TILE, width: int = 4096) -> DataFrame:
    """Centred moving median by row; the half-window at either end keeps the raw values. NULL and NaN are missing.

    Tiles of `width` rows, or k where that is more, each with the neighbours its windows need. Within a tile
    one sorted buffer takes a row in and a row out at every step, so a row costs O(log k) comparisons
    and a tile holds k values, whatever k is.
    """
    before, after = _centred(k)
    width = max(width, k)
    d = ordered(df, by, order, [Scan("_pos", F.lit(1).cast("long"), "sum")], rows=rows)
    d = join_groups(d, d.groupBy(*by).agg(F.max("_pos").alias("_n")), by)
    tile = lambda shift: F.floor((F.col("_pos") + shift) / width)
    wide = d.withColumn("_tile_no", F.explode(F.sequence(tile(-after), tile(before)))).withColumn("_core", F.col("_tile_no") == tile(0))

    def run(t):
        t = t.sort_by("_pos")
        at = np.flatnonzero(t.column("_core").to_numpy(zero_copy_only=False))
        med = _sliding_median(t.column(v).cast("double").to_numpy(zero_copy_only=False), at, before, after)
        return t.take(at).append_column("_m", pa.array(med, pa.float64(), mask=np.isnan(med)))

    fields = ", ".join(f"`{c}` {t}" for c, t in wide.dtypes)
    d = wide.groupBy(*by, "_tile_no").applyInArrow(run, f"{fields}, _m double")
    half = F.least(F.lit(k // 2), F.floor(F.col("_n") / 2))
    edge = (F.col("_pos") <= half) | (F.col("_pos") > F.col("_n") - half)
    return d.withColumn(out, F.when(edge, F.col(v)).otherwise(F.col("_m"))).select(*df.columns, out)


def detrend_running_mean(df: DataFrame, by: list[str], axis: str, v: str, k: int = 41, out: str = "detrended") -> DataFrame:
    """Value minus its centred running mean along an integer axis."""
    before, after = _centred(k)
    return moving(df, by, axis, {"_m": F.avg(v)}, before, after).withColumn(out, F.col(v) - F.col("_m")).drop("_m")


def mean_power_section(samples: DataFrame, n_look: int, bins: tuple[int, int] | None = None, line: str = "line_id") -> DataFrame:
    """Power section: mean over passes, moving mean along track, dB below the line's peak.

    The depth window is a bin range and goes into the scan of the samples.
    """
    d = samples if bins is None else samples.where(F.col("bin").between(*bins))
    p = d.groupBy(line, "col", "bin").agg(F.avg(power(F.col("re"), F.col("im"))).alias("power"))
    if n_look > 1:
        before, after = _centred(n_look)
        p = moving(p, [line, "bin"], "col", {"_m": F.avg("power")}, before, after).drop("power").withColumnRenamed("_m", "power")
    p = p.withColumn("db", db(F.col("power")))
    return spread_over(p, [line], {"_top": F.max("db")}, bounded=False).select(
        line, "col", "bin", (F.col("db") - F.col("_top")).alias("db"))


def _box(a: np.ndarray, k: int) -> np.ndarray:
    """Centred mean of k rows over the values that are there, NaN where there are none."""
    ok = np.isfinite(a)
    pad = [(k // 2 + 1, k // 2), (0, 0)]
    total, n = (np.pad(v, pad).cumsum(axis=0) for v in (np.where(ok, a, 0.0), ok.astype(float)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total[k:] - total[:-k]) / (n[k:] - n[:-k])


def _smoothed(pdf: pd.DataFrame, z: np.ndarray, lo: int, hi: int, nc: int) -> np.ndarray:
    """Columns lo..hi-1 of a line's image over the depths z, smoothed by 5 depths x 3 columns; -inf where a sample is missing.

    `pdf` (pos, z, db) holds the neighbour columns too.
    """
    a, b = max(lo - 1, 0), min(hi + 1, nc)
    img = np.full((len(z), b - a), np.nan)
    img[np.searchsorted(z, pdf["z"].to_numpy(float)), pdf["pos"].to_numpy(np.int64) - a] = pdf["db"].to_numpy(float)
    there = np.isfinite(img)
    img = _box(_box(img, 5).T, 3).T
    return np.where(there & np.isfinite(img), img, -np.inf)[:, lo - a:hi - a]


def _follow(z: np.ndarray, step: float, zmin: float):
    """For a column's values: from every row, the row of the strongest value within one step, the lowest depth on a tie; -1 for none."""
    low = np.maximum(np.searchsorted(z, z - step, "left"), np.searchsorted(z, zmin, "left"))
    high = np.searchsorted(z, z + step, "right")
    at = low[:, None] + np.arange(max(int((high - low).max(initial=0)), 1))
    inside, at = at < high[:, None], np.minimum(at, len(z) - 1)

    def of(values: np.ndarray) -> np.ndarray:
        near = np.where(inside, values[at], -np.inf)
        best = near.argmax(axis=1)
        return np.where(near.max(axis=1) > -np.inf, low + best, -1)
    return of


def _through(maps, rows: np.ndarray) -> np.ndarray:
    """Rows followed through one map after another; -1 stays."""
    for m in maps:
        rows = np.where(rows >= 0, m[rows], -1)
    return rows


def track_layer(section: DataFrame, line: str = "line_id", window=(250.0, 330.0), step: float = 6.0, zmin: float = 150.0,
                smooth: int = 9, start: int | None = None, width: int = LAYER_COLUMNS, rows: int = ROWS_PER_TILE) -> DataFrame:
    """Follow the strongest return along a section (line, col, z, db), outward from a start column.

    Each column looks within `step` of its neighbour's depth, a recursion along the line. A depth that a
    column lacks is no candidate there. Where nothing is near, or no depth lies in `window`, the path
    ends and the depth is NULL. The result is the moving median of the path, raw at the ends.

    A line is cut into tiles of `width` columns, each with the neighbour columns its smoothing needs. What a tile does to
    a path is a map from the depth it enters at to the depth it leaves at, for all depths at once; such maps are
    put together tile after tile, FOLD of them at a time, which gives each tile the depth it is entered at, and then
    every tile follows its own columns. No task sees more than one tile's columns or FOLD maps and
    one map for FOLD tiles. The depths of a line are the bins of its traces.
    """
    kinds = dict(section.dtypes)
    sm = section.where(F.col(line).isNotNull() & F.col("col").isNotNull() & F.col("z").isNotNull() & ~F.isnan(F.col("z").cast("double"))).groupBy(
        line, "col", F.col("z").cast("double").alias("z")).agg(F.avg("db").cast("double").alias("db"))
    axis = sm.groupBy(line).agg(F.array_sort(F.collect_set("z")).alias("axis"))
    cols = ordered(sm.select(line, "col").distinct(), [line], "col", [Scan("_i", F.lit(1).cast("long"), "sum")], rows=rows).withColumn("pos", F.col("_i") - 1).drop("_i")
    cols = cut_lineage(cols)
    info = axis.join(cols.groupBy(line).agg(F.count(F.lit(1)).alias("nc")), line)
    seed = F.lit(start) if start is not None else F.floor((F.col("nc") + 1) / 2) - 1
    info = info.withColumn("seed", F.greatest(F.lit(0), F.least(F.col("nc") - 1, seed)).cast("long"))
    home = F.floor(F.col("seed") / width)
    tiles = info.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("nc") - 1) / width)))).withColumn("k", F.col("tile") - home)
    # Columns of their own, as tiles and samples stem from one frame.
    tiles = cut_lineage(tiles).select(*[F.col(c).alias(c) for c in tiles.columns])
    around = F.array_distinct(F.array(F.floor((F.col("pos") - 1) / width), F.floor(F.col("pos") / width), F.floor((F.col("pos") + 1) / width)))
    data = sm.join(cols, [line, "col"]).withColumn("tile", F.explode(around)).select(line, "tile", "col", "pos", "z", "db")
    at = lambda i: (int(i["tile"]) * width, min((int(i["tile"]) + 1) * width, int(i["nc"])))

    def origin(z, img, lo, seed) -> int:
        v = np.where((z >= window[0]) & (z <= window[1]), img[:, seed - lo], -np.inf)
        return int(v.argmax()) if len(v) and v.max() > -np.inf else -1

    def transfer(key, pdf, info):
        """The tile's map away from the start column; the tile that holds it gives the rows it is left at on either side."""
        if not len(info):                              # beyond either end of the line
            return pd.DataFrame(columns=[line, "k", "m"], dtype=object)
        i = info.iloc[0]
        z, (lo, hi), k = np.asarray(i["axis"], float), at(i), int(i["k"])
        img = _smoothed(pdf, z, lo, hi, int(i["nc"]))
        follow = _follow(z, step, zmin)
        if k == 0:
            s = int(i["seed"])
            first = np.array([origin(z, img, lo, s)])
            m = [_through((follow(img[:, c]) for c in steps), first)[0] for steps in (range(s - lo - 1, -1, -1), range(s - lo + 1, hi - lo))]
        else:
            m = _through((follow(img[:, c]) for c in (range(hi - lo) if k > 0 else range(hi - lo - 1, -1, -1))), np.arange(len(z)))
        return pd.DataFrame({line: [i[line]], "k": [k], "m": [[int(v) for v in m]]})

    kind = f"{line} {kinds[line]}"
    maps = cut_lineage(data.groupBy(line, "tile").cogroup(tiles.groupBy(line, "tile")).applyInPandas(transfer, f"{kind}, k long, m array<int>"))
    entries = _entries(maps, line, kind)

    def unfold(key, pdf, info):
        if not len(info):
            return pd.DataFrame(columns=[line, "col", "depth"], dtype=object)
        i = info.iloc[0]
        z, (lo, hi), k = np.asarray(i["axis"], float), at(i), int(i["k"])
        img = _smoothed(pdf, z, lo, hi, int(i["nc"]))
        follow = _follow(z, step, zmin)
        path = np.full(hi - lo, -1)
        s = int(i["seed"]) - lo if k == 0 else -1 if k > 0 else hi - lo
        entry = origin(z, img, lo, int(i["seed"])) if k == 0 else int(i["entry"])
        if k == 0:
            path[s] = entry
        for steps in (range(s + 1, hi - lo), range(s - 1, -1, -1)):
            row = entry
            for c in steps:
                row = int(follow(img[:, c])[row]) if row >= 0 else -1
                path[c] = row
        own = pdf[(pdf["pos"] >= lo) & (pdf["pos"] < hi)].drop_duplicates("pos").sort_values("pos")
        depth = pd.array([float(z[r]) if r >= 0 else None for r in path], dtype="Float64")
        return pd.DataFrame({line: i[line], "col": own["col"].to_numpy(), "depth": depth})

    placed = tiles.join(entries, [line, "k"], "left").withColumn("entry", F.coalesce("entry", F.lit(-1)))
    path = data.groupBy(line, "tile").cogroup(placed.groupBy(line, "tile")).applyInPandas(unfold, f"{kind}, col {kinds['col']}, depth double")
    med = moving_median(cut_lineage(path), [line], "col", "depth", smooth, "_med", rows)
    return med.select(line, "col", F.when(F.col("depth").isNotNull(), F.col("_med")).alias("depth"))


def _entries(maps: DataFrame, line: str, kind: str) -> DataFrame:
    """The row at which each tile but the first is entered: line, k, entry. `maps`: line, k, m; k counts tiles from the start."""
    side, run = F.signum("k").cast("int"), F.floor((F.abs("k") - 1) / FOLD)
    steps = maps.where("k <> 0").withColumn("side", side).withColumn("run", run)

    def together(key, pdf):
        ms = [np.asarray(m) for m in pdf.sort_values("k", key=abs)["m"]]
        return pd.DataFrame({line: [key[0]], "side": [key[1]], "run": [key[2]], "m": [_through(ms, np.arange(len(ms[0]))).tolist()]})

    def begin(key, pdf, first):
        row, out = first["m"].iloc[0][0 if key[1] < 0 else 1], []
        for r, m in pdf.sort_values("run")[["run", "m"]].itertuples(index=False):
            out.append((key[0], key[1], r, row))
            row = m[row] if row >= 0 else -1
        return pd.DataFrame(out, columns=[line, "side", "run", "entry"])

    def each(key, pdf, first):
        row, out = first["entry"].iloc[0], []
        for k, m in pdf.sort_values("k", key=abs)[["k", "m"]].itertuples(index=False):
            out.append((key[0], k, row))
            row = m[row] if row >= 0 else -1
        return pd.DataFrame(out, columns=[line, "k", "entry"])

    runs = steps.groupBy(line, "side", "run").applyInPandas(together, f"{kind}, side int, run long, m array<int>")
    start = maps.where("k = 0").select(line, F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), "m").join(steps.select(line, "side").distinct(), [line, "side"])
    first = runs.groupBy(line, "side").cogroup(start.groupBy(line, "side")).applyInPandas(begin, f"{kind}, side int, run long, entry int")
    return steps.groupBy(line, "side", "run").cogroup(first.groupBy(line, "side", "run")).applyInPandas(each, f"{kind}, k long, entry int")


def thin_columns(df: DataFrame, by: list[str], order: str, target: int = 400, rows: int = ROWS_PER_TILE) -> DataFrame:
    """Every step-th row along `order`, about `target` per group, starting with the first."""
    d = ordered(df, by, order, [Scan("_i", F.lit(1).cast("long"), "sum")], rows=rows)
    n = d.groupBy(*by).agg(F.max("_i").alias("_n"))
    step = F.greatest(F.lit(1), F.round(F.col("_n") / target)).cast("long")
    return join_groups(d, n, by).where((F.col("_i") - 1) % step == 0).select(*df.columns)


def region_quality(blocks: DataFrame, regions: dict[str, Column], by: list[str], fields: list[str]) -> DataFrame:
    """Means of quality fields inside named regions, side by side in one aggregation."""
    return blocks.groupBy(*by).agg(*[
        a for r, c in regions.items() for a in
        [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(f"n_{r}")] + [F.avg(F.when(c, F.col(f))).alias(f"{f}_{r}") for f in fields]])


def array_mean(series: DataFrame, by: str, v: str) -> DataFrame:
    """Mean over points at each time, and how far the points spread."""
    return series.groupBy(by).agg(F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("spread"))


def block_size_sweep(results: DataFrame, by: list[str], size: str, ref_size: int, cell: list[str], a: str = "a", sd: str = "sd") -> DataFrame:
    """How results at other block sizes compare with one size, at the same positions.

    Share of agreeing signs, median shift in combined sigmas, and the share of
    flips significant on both sides. The reference rows meet the others by an
    equi-join on the position.
    """
    ref = results.where(F.col(size) == ref_size).select(*by, *cell, F.col(a).alias("_ra"), F.col(sd).alias("_rs"))
    j = results.join(ref, [*by, *cell]).where(F.col(a).isNotNull() & F.col("_ra").isNotNull())
    same = F.signum(a) == F.signum("_ra")
    den = F.greatest(F.sqrt(F.col(sd) * F.col(sd) + F.col("_rs") * F.col("_rs")), F.lit(2.220446049250313e-16))
    clear = (F.abs(a) > F.col(sd)) & (F.abs("_ra") > F.col("_rs"))
    j = j.withColumn("_z", F.abs(F.col(a) - F.col("_ra")) / den)
    shift = medians(j, [*by, size], "_z", "shift_sigma").drop("n")
    g = j.groupBy(*by, size).agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("sign_agree"),
                                 F.avg((~same & clear).cast("double")).alias("sig_flip"))
    return g.join(shift, [*by, size], "left")


def residual_budget(epochs: DataFrame, resid: DataFrame, rho: DataFrame, line: list[str], block: str, ref_depth: float = 100.0,
                    model_share: float = 0.05) -> DataFrame:
    """Where the residual goes, in mm: pair closure, per-pass repeatable part, model, remainder.

    `epochs` rms per (line, block); `resid` epoch residuals; `rho` from
    `repeatable_residual`. Blocks per line are few, so medians are built in.
    """
    mm = 1e3 * ref_depth
    net = epochs.groupBy(*line, block).agg(F.first("rms").alias("rms")).groupBy(*line).agg((mm * F.median("rms")).alias("closure"))
    sd = resid.groupBy(*line, block).agg(F.coalesce(F.stddev_samp("resid"), F.lit(0.0)).alias("sd")).groupBy(*line).agg(
        (mm * F.median("sd")).alias("total"))
    j = net.join(sd, line).join(rho.select(*line, "rho"), line)
    per_pass = F.col("total") * F.sqrt(F.greatest(F.coalesce(F.col("rho"), F.lit(0.0)), F.lit(0.0)))
    j = j.withColumn("per_pass", per_pass).withColumn("model", model_share * F.col("total"))
    sq = lambda c: F.col(c) * F.col(c)
    return j.select(*line, "closure", "per_pass", "model", "total",
                    F.sqrt(F.greatest(sq("total") - sq("closure") - sq("per_pass") - sq("model"), F.lit(0.0))).alias("unexplained"))


def plate_shape(coefs: DataFrame, by: list[str], order: int, norm: float, grid: list[float]) -> DataFrame:
    """Neutral depth of a bending plate from the Legendre responses, by trial depths.

    `coefs`: by, k, adm, sd for every k. For each trial the amplitude is the
    weighted projection on P1..PK of a plate (P0 takes up the surface
    reference); the interval is where the misfit stays within 1 of its minimum,
    open (NULL) at the ends of the grid.
    """
    zn = F.col("zn")
    m = F.when(F.col("k") == 1, zn * norm / 2 - norm ** 2 / 4).when(F.col("k") == 2, F.lit(-norm ** 2 / 12)).otherwise(0.0)
    ok = coefs.groupBy(*by).agg(F.min((F.col("adm").isNotNull() & (F.col("sd") > 0)).cast("int")).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    d = coefs.join(ok.where((F.col("_ok") == 1) & (F.col("_n") == order + 1)).select(*by), by, "left_semi").where("k >= 1")
    d = d.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(g)).alias("z")) for i, g in enumerate(grid)])))
    d = d.select(*by, "adm", (1 / (F.col("sd") * F.col("sd"))).alias("w"), F.col("_g.i").alias("i"), F.col("_g.z").alias("zn"), "k").withColumn("m", m)
    s = d.groupBy(*by, "i", "zn").agg(F.sum(F.col("w") * F.col("m") * F.col("adm")).alias("_my"), F.sum(F.col("w") * F.col("m") * F.col("m")).alias("_mm"),
                                      F.sum(F.col("w") * F.col("adm") * F.col("adm")).alias("_yy"))
    s = s.withColumn("amp", safe_div(F.col("_my"), F.col("_mm"))).withColumn("J", F.col("_yy") - F.col("amp") * F.col("_my"))
    grp = Window.partitionBy(*by)                      # grid rows per group
    s = s.withColumn("_b", F.min(F.struct("J", "i", "zn", "amp", "_mm")).over(grp))
    inside = F.col("J") <= F.col("_b.J") + 1
    g = s.groupBy(*by).agg(F.first("_b").alias("b"), F.min(F.when(inside, F.col("i"))).alias("_lo"), F.max(F.when(inside, F.col("i"))).alias("_hi"),
                           F.min(F.when(inside, F.col("zn"))).alias("_zlo"), F.max(F.when(inside, F.col("zn"))).alias("_zhi"))
    last = len(grid) - 1
    inner = (F.col("b.i") > 0) & (F.col("b.i") < last)
    return g.select(*by, F.col("b.zn").alias("zn"), F.when(inner & (F.col("_lo") > 0), F.col("_zlo")).alias("zn_lo"),
                    F.when(inner & (F.col("_hi") < last), F.col("_zhi")).alias("zn_hi"), F.col("b.amp").alias("amp"),
                    (F.col("b.amp") * F.sqrt(F.col("b._mm"))).alias("significance"),
                    (F.greatest(F.col("b.J"), F.lit(0.0)) / max(order - 1, 1)).alias("chi2"))


