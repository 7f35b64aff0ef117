"""Nearest-position matches, projections on tracks and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.columns import safe_div
from echofold.operators.nearest import CAP, cell_tree, near_pairs
from echofold.operators.quantiles import medians, robust_scale
from echofold.operators.scan import Scan, join_groups, ordered
from echofold.params import MAD_SCALE, NOISE_FLOOR, ROWS_PER_TILE
from echofold.session import cut_lineage

#: So many lines, with one number each, are broadcast at most.
BROADCAST_LINES = 200_000


def nearest_match(a: DataFrame, b: DataFrame, on: str, tol: float, by=(), id_b: str = "id", rows: int = ROWS_PER_TILE) -> DataFrame:
    """For every row of `a` the nearest row of `b` along `on`, if within `tol`.

    A row of `b` may serve several rows of `a`; the lower position, then the
    lowest id, wins a tie, and gaps equal but for rounding are one. Columns of `b` come back as a struct `b`, with `gap`.
    The nearest on each side comes from a running fill of the two sides
    together: no range join, and no side is broadcast.
    """
    by = list(by)
    grp = by or ["_all"]
    if not by:
        a, b = a.withColumn("_all", F.lit(0)), b.withColumn("_all", F.lit(0))
    keep = [c for c in a.columns if c != "_all"]
    x = F.col(on).cast("double")
    point = F.struct(x.alias("x"), F.struct(*[c for c in b.columns if c != "_all"]).alias("row"))
    pts = b.where(x.isNotNull()).groupBy(*grp, x.alias("_x")).agg(F.min_by(point, F.col(id_b)).alias("_p")).withColumn("_is_a", F.lit(0))
    keys = a.where(x.isNotNull()).select(*grp, x.alias("_x"), F.lit(1).alias("_is_a"), F.struct(*keep).alias("_row"))
    both = ordered(keys.unionByName(pts, allowMissingColumns=True), grp, ["_x", "_is_a"], [
        Scan("_lo", F.col("_p"), "last"), Scan("_hi", F.col("_p"), "next")], rows=rows).where("_is_a = 1")
    g_lo, g_hi = F.col("_x") - F.col("_lo.x"), F.col("_hi.x") - F.col("_x")
    rounding = NOISE_FLOOR * F.greatest(F.abs("_x"), F.abs("_lo.x"), F.abs("_hi.x"))
    lower = g_hi.isNull() | F.coalesce(g_lo - g_hi <= rounding, F.lit(False))
    gap = F.when(lower, g_lo).otherwise(g_hi)
    return both.select("_row.*", gap.alias("gap"), F.when(lower, F.col("_lo.row")).otherwise(F.col("_hi.row")).alias("b")).where(
        F.col("gap") <= tol)


def nearest_match_xy(a: DataFrame, b: DataFrame, tol: float, id_a: str, id_b: str, xa=("x", "y"), xb=("x", "y"), by=(), crowd: int = CAP) -> DataFrame:
    """Nearest row of `b` within `tol` in the plane, per row of `a`.

    Cells of size tol; `a` looks into its own and the eight around it, and the
    minimum is combined map-side. Coinciding positions of `b` are merged (lowest id). Where a cell
    holds more than `crowd` positions, the rows of `a` that would look into it search the tree of cells
    instead, in which crowded cells are cut; the result is the same. Both sides keep only id and position until the match is made.
    """
    by = list(by)
    cell = lambda c: F.floor(F.col(c) / tol)
    pb = b.where(F.col(xb[0]).isNotNull() & F.col(xb[1]).isNotNull()).groupBy(
        *by, F.col(xb[0]).alias("_bx"), F.col(xb[1]).alias("_by")).agg(F.min(id_b).alias(id_b))
    cells = pb.withColumn("_cx", F.floor(F.col("_bx") / tol)).withColumn("_cy", F.floor(F.col("_by") / tol))
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    pa = a.select(*by, id_a, F.col(xa[0]).cast("double").alias("_ax"), F.col(xa[1]).cast("double").alias("_ay"))
    looks = pa.withColumn("_cx", near("_ax")).withColumn("_cy", near("_ay"))
    crowded = cells.groupBy(*by, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).drop("_n")
    crowded = cut_lineage(crowded)
    hits = None
    if not crowded.isEmpty():
        full = looks.join(crowded, [*by, "_cx", "_cy"], "left_semi").select(*by, id_a).distinct()
        tree = cell_tree(pb, "_bx", "_by", by, cap=crowd)
        hits = near_pairs(pa.join(full, [*by, id_a], "left_semi"), tree, [id_a], "_ax", "_ay", within=tol).select(*by, id_a, "gap", F.col(f"point.{id_b}").alias(id_b))
        looks = looks.join(full, [*by, id_a], "left_anti")
    j = looks.join(cells, [*by, "_cx", "_cy"]).withColumn("gap", F.hypot(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by"))).select(*by, id_a, "gap", id_b)
    j = j if hits is None else j.unionByName(hits)
    best = j.where(F.col("gap") <= tol).groupBy(*by, id_a).agg(F.min(F.struct("gap", id_b)).alias("_m"))
    return best.select(*by, id_a, f"_m.{id_b}", "_m.gap")


def rms_disagreement(matched: DataFrame, by: list[str], va: Column, vb: Column, sa: Column, sb: Column, min_n: int = 4) -> DataFrame:
    """Rms of matched differences, the rms their sigmas lead to expect, and the ratio."""
    m = matched.select(*by, (va - vb).alias("_d"), (sa * sa + sb * sb).alias("_e")).where("_d is not null")
    g = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"), F.sqrt(F.avg("_e")).alias("expected"))
    return g.where(F.col("n") >= min_n).withColumn("excess", F.col("rms") / F.greatest(F.col("expected"), F.lit(2.220446049250313e-16)))


def worst_disagreement(pairs: DataFrame, duplicate: Column) -> DataFrame:
    """Largest rms among build pairs that involve the duplicate and among the others."""
    return pairs.agg(F.max(F.when(duplicate, F.col("rms"))).alias("worst_duplicate"), F.max(F.when(~duplicate, F.col("rms"))).alias("worst_other"))


def method_floor(matched: DataFrame, depth: str, va: Column, vb: Column, by=()) -> DataFrame:
    """Rms between two builds of one line at every depth."""
    d = matched.select(*by, depth, (va - vb).alias("_d")).where("_d is not null")
    return d.groupBy(*by, depth).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"), F.count(F.lit(1)).alias("n"))


def build_change(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], v: str, s: str) -> DataFrame:
    """Per-block change in combined sigmas between two results, summarised per line."""
    j = a.select(*keys, F.col(v).alias("_va"), F.col(s).alias("_sa")).join(b.select(*keys, F.col(v).alias("_vb"), F.col(s).alias("_sb")), keys)
    sig = F.greatest(F.sqrt(F.col("_sa") * F.col("_sa") + F.col("_sb") * F.col("_sb")), F.lit(2.220446049250313e-16))
    z = j.withColumn("z", F.abs(F.col("_va") - F.col("_vb")) / sig).where("z is not null")
    med = medians(z, by, "z", "median_z")
    top = z.groupBy(*by).agg(F.max("z").alias("max_z"))
    return join_groups(med, top, by)


def project_on_track(points: DataFrame, tracks: DataFrame, point_id: str = "site", rows: int = ROWS_PER_TILE) -> DataFrame:
    """Along-track position and offset of each point on the closest of several tracks.

    The nearest vertex of a line, then the better of its two segments, then the
    better line. A line can win only if its nearest vertex is at most half its longest segment
    farther than the nearest vertex of all, so the search in the tree of cells keeps these lines and no others, for
    points next to a track as for points far off. `points`: id, x, y; `tracks`: line_id, col, x, y, along_m.
    Points and vertices without a position are left out.
    """
    kind = dict(points.dtypes)[point_id]
    known = points.where("x is not null and y is not null").select(F.col(point_id).alias("id"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).distinct()
    seg = ordered(tracks, ["line_id"], "col", [
        Scan("_b", F.struct("x", "y", "along_m"), "prev"), Scan("_f", F.struct("x", "y", "along_m"), "follow")], rows=rows)
    step = F.hypot(F.col("_f.x") - F.col("x"), F.col("_f.y") - F.col("y"))
    longest = cut_lineage(seg.groupBy("line_id").agg((F.coalesce(F.max(step), F.lit(0.0)) / 2).alias("_long")))
    few = longest.count() <= BROADCAST_LINES
    seg = join_groups(seg, F.broadcast(longest) if few else longest, ["line_id"])
    tree = cell_tree(seg, "x", "y", half=F.col("_long"))
    if tree is None:
        return points.sparkSession.createDataFrame([], f"{point_id} {kind}, line_id {dict(tracks.dtypes)['line_id']}, along_m double, off_m double")
    pair = near_pairs(known, tree, ["id", "px", "py"], "px", "py").withColumn("line_id", F.col("point.line_id"))
    near = pair.groupBy("id", "px", "py", "line_id").agg(F.min(F.struct("gap", F.col("point.col").alias("col"), "point")).alias("m"))
    out = near.select("id", "px", "py", "line_id", *[F.col(f"m.point.{c}").alias(c) for c in ("x", "y", "along_m", "_b", "_f")])

    def side(c: str) -> Column:
        vx, vy = F.col(f"{c}.x") - F.col("x"), F.col(f"{c}.y") - F.col("y")
        l2 = F.nullif(vx * vx + vy * vy, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x")) * vx + (F.col("py") - F.col("y")) * vy) / l2))
        t = F.when(l2.isNotNull(), t)
        off = F.hypot(F.col("x") + t * vx - F.col("px"), F.col("y") + t * vy - F.col("py"))
        return F.struct(off.alias("off"), F.col("line_id").alias("line_id"), (F.col("along_m") + t * (F.col(f"{c}.along_m") - F.col("along_m"))).alias("along"))

    cand = out.select("id", F.explode(F.array(side("_b"), side("_f"))).alias("s")).where("s.off is not null")
    best = cand.groupBy("id").agg(F.min("s").alias("s"))
    return best.select(F.col("id").alias(point_id), "s.line_id", F.col("s.along").alias("along_m"), F.col("s.off").alias("off_m"))


def polyline_crossing(tracks: DataFrame, polyline: DataFrame, max_m: float = 150.0, step: float = 20.0, max_segment: float = 5000.0,
                      part: str = "part", rows: int = ROWS_PER_TILE) -> DataFrame:
    """Track position closest to a boundary, if it comes within `max_m`.

    The boundary (part, seq, x, y) is densified to about `step`; longer
    segments than max_segment are breaks. Only cells of size max_m that hold
    both a track and a boundary point are compared, boundary points sharing a
    `step`-sized spot being merged to their own position first.
    """
    nxt = ordered(polyline, [part], "seq", [Scan("_n", F.struct("x", "y"), "follow")], rows=rows)
    length = F.hypot(F.col("_n.x") - F.col("x"), F.col("_n.y") - F.col("y"))
    s = nxt.withColumn("_L", length).where((F.col("_L") > 0) & (F.col("_L") <= max_segment))
    m = F.greatest(F.lit(2), F.ceil(F.col("_L") / step)).cast("int")
    s = s.withColumn("_m", m).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    t = F.col("_k") / (F.col("_m") - 1)
    dense = s.select((F.col("x") + t * (F.col("_n.x") - F.col("x"))).alias("gx"), (F.col("y") + t * (F.col("_n.y") - F.col("y"))).alias("gy")).distinct()
    dense = dense.withColumn("_cx", F.floor(F.col("gx") / max_m)).withColumn("_cy", F.floor(F.col("gy") / max_m))
    tr = tracks.select("line_id", "col", "along_m", "x", "y", F.explode(F.sequence(F.floor(F.col("x") / max_m) - 1, F.floor(F.col("x") / max_m) + 1)).alias("_cx"))
    tr = tr.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y") / max_m) - 1, F.floor(F.col("y") / max_m) + 1)))
    j = tr.join(dense, ["_cx", "_cy"]).withColumn("dist", F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy"))).where(F.col("dist") < max_m)
    return j.groupBy("line_id").agg(F.min(F.struct("dist", "col", "along_m")).alias("m")).select("line_id", "m.along_m", "m.dist")


def layer_to_blocks(blocks: DataFrame, picks: DataFrame, half_len: float, max_cross: float = 60.0, max_match: float = 60.0,
                    min_frac: float = 0.25, n_mad: float = 5.0, rows: int = ROWS_PER_TILE) -> DataFrame:
    """Median layer thickness per block from the picks in its along-track capsule.

    Picks further than n_mad scaled MADs from the line's median do not count.
    A block's direction is that to its nearest neighbour. It needs a pick
    within max_match and min_frac of its capsule's picks surviving.
    `blocks`: line_id, block, x, y; `picks`: line_id, px, py, h (metres). Where no line has more than
    `rows` picks, medians are taken where the picks of a line lie, else by counts in tiles.
    """
    most = picks.groupBy("line_id").count().agg(F.max("count")).first()[0]
    bounded = (most or 0) <= rows
    if bounded:
        line = Window.partitionBy("line_id")
        p = picks.where("line_id is not null").repartition("line_id").withColumn("med", F.median("h").over(line))
        p = p.withColumn("sd", F.median(F.abs(F.col("h") - F.col("med"))).over(line) * MAD_SCALE).where("med is not null")
    else:
        p = picks.join(robust_scale(picks, ["line_id"], "h", rows), "line_id")
    good = F.coalesce(F.abs(F.col("h") - F.col("med")) <= n_mad * F.greatest(F.col("sd"), F.lit(1.4826 * 2.220446049250313e-16)), F.lit(False))
    p = p.withColumn("_ok", good).select("line_id", "px", "py", "h", "_ok")
    b = blocks.where("x is not null and y is not null").select("line_id", "block", "x", "y")
    near = nearest_other(b)
    b = b.join(near, ["line_id", "block"])
    reach = max(half_len + max_cross, max_match)
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / reach), F.floor((F.col(c) + reach) / reach)))
    bb = b.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))
    pp = p.withColumn("_cx", F.floor(F.col("px") / reach)).withColumn("_cy", F.floor(F.col("py") / reach))
    j = bb.join(pp, ["line_id", "_cx", "_cy"])
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    along, cross = dx * F.col("ux") + dy * F.col("uy"), dy * F.col("ux") - dx * F.col("uy")
    j = j.withColumn("_in", (F.abs(along) <= half_len) & (F.abs(cross) <= max_cross)).withColumn("_d", F.hypot(dx, dy))
    j = j.select("line_id", "block", "h", "_ok", "_in", "_d").where(F.col("_in") | (F.col("_d") <= max_match))
    agg = [F.min("_d").alias("match_m"), F.sum(F.col("_in").cast("long")).alias("n_in"),
           F.sum((F.col("_in") & F.col("_ok")).cast("long")).alias("n_kept")]
    if bounded:
        agg.append(F.median(F.when(F.col("_in") & F.col("_ok"), F.col("h"))).alias("thickness"))
    g = j.groupBy("line_id", "block").agg(*agg)
    g = g.where((F.col("n_in") > 0) & (F.col("match_m") <= max_match) & (F.col("n_kept") > 0) & (F.col("n_kept") >= min_frac * F.col("n_in")))
    if not bounded:
        g = g.join(medians(j.where("_in and _ok"), ["line_id", "block"], "h", "thickness", rows).drop("n"), ["line_id", "block"])
    return g.select("line_id", "block", "thickness", "n_kept", "n_in", "match_m")


def nearest_other(blocks: DataFrame) -> DataFrame:
    """Unit vector from each block (once per line) to its nearest neighbour on the line, the lowest block on a tie.

    A line of few blocks is one cell of the tree, a long one is cut.
    """
    b = blocks.select("line_id", "block", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    tree = cell_tree(b, "x", "y", ["line_id"])
    if tree is None:
        return b.where("1 = 0").select("line_id", "block", F.col("x").alias("ux"), F.col("y").alias("uy"))
    j = near_pairs(b, tree, ["block"], "x", "y", others=True).where("point.block <> block")
    m = j.groupBy("line_id", "block", "x", "y").agg(F.min(F.struct("gap", F.col("point.block").alias("o"), F.col("point.x").alias("ox"), F.col("point.y").alias("oy"))).alias("m"))
    return m.where("m.gap > 0").select("line_id", "block", ((F.col("m.ox") - F.col("x")) / F.col("m.gap")).alias("ux"), ((F.col("m.oy") - F.col("y")) / F.col("m.gap")).alias("uy"))


def window_mean_at(df: DataFrame, windows: DataFrame, half: Column | float, by: list[str], col: str = "col", v: str = "v",
                   centre: str = "x_win") -> DataFrame:
    """Mean of a per-column value over the columns around each window centre (rounded, clipped to the data).

    Windows name their own columns, so this is an equi-join on the column.
    """
    half = half if isinstance(half, Column) else F.lit(half)
    w = windows.withColumn(col, F.explode(F.sequence(
        (F.round(centre) - half).cast("int"), (F.round(centre) + half).cast("int"))))
    return w.join(df.select(*by, col, v), [*by, col]).groupBy(*windows.columns).agg(F.avg(v).alias(v))


def survey_axis(blocks: DataFrame, x: str, y: str, orient: Column, by=()) -> DataFrame:
    """Principal direction of the block positions, pointing where `orient` (a distance) grows.

    Closed form on the 2 x 2 covariance; one row (ux, uy, mean position).
    """
    g = blocks.groupBy(*by).agg(
        F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy"),
        F.covar_samp(x, orient).alias("_ox"), F.covar_samp(y, orient).alias("_oy"), F.avg(x).alias("x0"), F.avg(y).alias("y0"))
    ang = 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))
    g = g.withColumn("_ux", F.cos(ang)).withColumn("_uy", F.sin(ang))
    s = F.when(F.col("_ux") * F.col("_ox") + F.col("_uy") * F.col("_oy") < 0, -1.0).otherwise(1.0)
    return g.select(*by, (s * F.col("_ux")).alias("ux"), (s * F.col("_uy")).alias("uy"), "x0", "y0")


def rotate(blocks: DataFrame, axis: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Coordinates along and across the axis, from its origin."""
    j = blocks.join(axis, list(by)) if by else blocks.crossJoin(F.broadcast(axis))     # axis is a single row
    dx, dy = F.col(x) - F.col("x0"), F.col(y) - F.col("y0")
    return j.select(*blocks.columns, (dx * F.col("ux") + dy * F.col("uy")).alias("s"), (dy * F.col("ux") - dx * F.col("uy")).alias("n"))


def orient_seaward(blocks: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """Distance that grows seaward, its zero at the northern end, with the response's correlation along it.

    `blocks`: by, block, xb, lat, a. The sign follows the latitudes of the
    first and last blocks that have both a response and a position; latitudes equal but for
    rounding are equal, and the last block is the zero then. A response that falls seaward fails the job, as
    the line is turned the wrong way then; strict=False only reports it (r_sea).
    """
    ok = F.col("a").isNotNull() & F.col("lat").isNotNull()
    end = F.when(ok, F.struct("block", "lat", "xb"))
    g = blocks.groupBy(*by).agg(F.min(end).alias("_a"), F.max(end).alias("_b"))
    rounding = NOISE_FLOOR * F.greatest(F.abs("_a.lat"), F.abs("_b.lat"))
    north_first = F.col("_a.lat") - F.col("_b.lat") > rounding
    j = blocks.join(g.where("_a is not null"), by)
    j = j.withColumn("x_sea", F.when(north_first, F.col("xb") - F.col("_a.xb")).otherwise(F.col("_b.xb") - F.col("xb")))
    r = j.where(ok).groupBy(*by).agg(F.corr("a", "x_sea").alias("r_sea"))
    out = j.join(r, by).select(*blocks.columns, "x_sea", "r_sea")
    return assert_seaward(out) if strict else out


def assert_seaward(oriented: DataFrame) -> DataFrame:
    """Fail when a line's response falls seaward; a line without a correlation passes."""
    bad = F.raise_error("response falls seaward: check the orientation").cast("double")
    return oriented.withColumn("x_sea", F.when(F.col("r_sea").isNull() | (F.col("r_sea") > 0), F.col("x_sea")).otherwise(bad))
