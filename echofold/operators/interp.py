"""Interpolation joins: values of a sorted table at arbitrary keys, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.columns import safe_div
from echofold.operators.scan import Scan, join_groups, ordered
from echofold.params import ROWS_PER_TILE

POLICIES = ("null", "extrap", "hold", "nearest")


def _line(x: Column, x0: Column, v0: Column, x1: Column, v1: Column) -> Column:
    """Value at x on the line through two points; exact at both ends."""
    return F.when(x == x0, v0).when(x == x1, v1).otherwise(v0 + safe_div((x - x0) * (v1 - v0), x1 - x0))


def interp_join(left: DataFrame, right: DataFrame, on: str, value: str, by=(), policy: str = "null",
                out: str | None = None, rows: int = ROWS_PER_TILE, bounded: bool = False) -> DataFrame:
    """Linear interpolation of right.value, sorted by `on`, at left.`on`, per `by`.

    Outside the table: 'null' gives NULL, 'hold' the end value, 'extrap' the
    end segment prolonged, 'nearest' the value of the nearest point everywhere
    (the lower one on a tie). Table points sharing a position are averaged.
    Both sides meet by a union and two running fills, so neither a range join
    nor a whole group in one task is needed. `bounded` says that a group is small
    by construction (a pass, a profile) and a plain window will do.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    by, out = list(by), out or value
    grp = by or ["_all"]
    if not by:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
    x = F.col(on).cast("double")
    table = (right.where(x.isNotNull() & F.col(value).isNotNull())
             .groupBy(*grp, x.alias("_x")).agg(F.avg(value).alias("_v")))
    point = [F.col("_x").alias("x"), F.col("_v").alias("v")]
    if policy == "extrap":
        table = ordered(table, grp, "_x", [
            Scan("_before", F.struct(*point), "prev"), Scan("_after", F.struct(*point), "follow")], bounded, rows)
        point += [F.col("_before").alias("b"), F.col("_after").alias("a")]
    keep = [c for c in left.columns if c != "_all"]
    # Keys without a position get no value and stay out of the scan.
    keys = left.where(x.isNotNull()).select(
        *grp, x.alias("_x"), F.lit(1).alias("_is_key"), F.struct(*keep).alias("_row"))
    points = table.select(*grp, "_x", F.lit(0).alias("_is_key"), F.struct(*point).alias("_p"))
    both = keys.unionByName(points, allowMissingColumns=True)
    filled = ordered(both, grp, ["_x", "_is_key"], [
        Scan("_p0", F.col("_p"), "last"), Scan("_p1", F.col("_p"), "next")], bounded, rows).where("_is_key = 1")
    q, p0, p1 = F.col("_x"), F.col("_p0"), F.col("_p1")
    inside = p0.isNotNull() & p1.isNotNull()
    # A table point at the key itself sorts before it and is p0.
    exact = p0["x"] == q
    mid = F.when(exact, p0["v"]).when(inside, _line(q, p0["x"], p0["v"], p1["x"], p1["v"]))
    if policy == "hold":
        mid = F.coalesce(mid, p0["v"], p1["v"])
    elif policy == "nearest":
        mid = F.when(inside, F.when(q - p0["x"] <= p1["x"] - q, p0["v"]).otherwise(p1["v"])).otherwise(
            F.coalesce(p0["v"], p1["v"]))
    elif policy == "extrap":
        right_of = F.when(p0["b"].isNotNull(), _line(q, p0["b"]["x"], p0["b"]["v"], p0["x"], p0["v"]))
        left_of = F.when(p1["a"].isNotNull(), _line(q, p1["x"], p1["v"], p1["a"]["x"], p1["a"]["v"]))
        # A one-point table has no slope: its value everywhere.
        mid = F.coalesce(mid, right_of, left_of, p0["v"], p1["v"])
    got = filled.select("_row.*", mid.alias(out))
    lost = left.where(x.isNull()).select(*keep, F.lit(None).cast("double").alias(out))
    return got.unionByName(lost)


def interp_lookup(left: DataFrame, table: DataFrame, x: Column, on: str, values: dict[str, str],
                  lo: float, hi: float, n: int, max_rows: int = 100_000) -> DataFrame:
    """Interpolation in a table whose size is known beforehand; NULL outside it.

    `n` is the table's row count, a parameter of whoever built it, so the
    broadcast has a proven bound; larger tables belong in `interp_join`.
    Segments are spread over equal buckets and met by an equi-join.
    """
    if n > max_rows:
        raise ValueError(f"{n} rows is too many for a broadcast lookup; use interp_join")
    w = Window.orderBy(on)           # n rows, bounded above
    step = (hi - lo) / max(n - 1, 1)
    seg = table.select(F.col(on).alias("_x0"), F.lead(on).over(w).alias("_x1"), *[
        c for v in values for c in (F.col(v).alias(f"_{v}0"), F.lead(v).over(w).alias(f"_{v}1"))
    ], F.lead(on, 2).over(w).isNull().alias("_end")).where("_x1 is not null").withColumn("_cell", F.explode(F.sequence(
        F.floor((F.col("_x0") - lo) / step), F.floor((F.col("_x1") * (1 + 1e-12) - lo) / step))))
    keyed = left.withColumn("_x", x).withColumn("_cell", F.floor((F.col("_x") - lo) / step))
    # The last segment is closed, up to rounding of the end the caller worked out.
    hit = (F.col("_x") >= F.col("_x0")) & (
        (F.col("_x") < F.col("_x1")) | (F.col("_end") & (F.col("_x") <= F.col("_x1") * (1 + 1e-12))))
    keyed, seg = keyed.alias("k"), F.broadcast(seg).alias("s")
    got = keyed.join(seg, (F.col("k._cell") == F.col("s._cell")) & hit, "left")
    return got.select(*[F.col(f"k.{c}") for c in left.columns], *[
        _line(F.col("_x"), F.col("_x0"), F.col(f"_{v}0"), F.col("_x1"), F.col(f"_{v}1")).alias(o)
        for v, o in values.items()])


def read_at(df: DataFrame, x: str, v: str, at: float | Column, by: list[str], out: str = "value",
            reach: bool = True) -> DataFrame:
    """Profile value at one position, per group, in a single aggregation.

    The two samples around the position come from conditional max_by/min_by,
    combined map-side. With `reach` the profile has to extend to the position
    or beyond; nothing is extrapolated at its near end either.
    """
    at = F.lit(float(at)) if not isinstance(at, Column) else at
    ok = F.col(x).isNotNull() & F.col(v).isNotNull()
    pt = F.struct(F.col(x).cast("double").alias("x"), F.col(v).cast("double").alias("v"))
    got = df.groupBy(*by).agg(
        F.max(F.when(ok & (F.col(x) <= at), pt)).alias("_a"),
        F.min(F.when(ok & (F.col(x) >= at), pt)).alias("_b"),
        F.first(at).alias("_at"))
    value = _line(F.col("_at"), F.col("_a.x"), F.col("_a.v"), F.col("_b.x"), F.col("_b.v"))
    got = got.select(*by, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), value).alias(out))
    return got if not reach else got.where(F.col(out).isNotNull())


def tide_rate(keys: DataFrame, tide: DataFrame, ts: str, value: str, by=(), half_step: float | None = None,
              out: str = "rate", rows: int = ROWS_PER_TILE, bounded: bool = False) -> DataFrame:
    """Rate of change of a tabulated series at given times.

    With `half_step`: central difference of the interpolated series. Without:
    the two neighbours of the first sample at or after the key; NULL within two
    samples of either end.
    """
    by = list(by)
    if half_step is not None:
        hi = interp_join(keys.withColumn("_t", F.col(ts)).withColumn(ts, F.col(ts) + half_step),
                         tide, ts, value, by, out="_hi", rows=rows)
        lo = interp_join(hi.withColumn(ts, F.col("_t") - half_step), tide, ts, value, by, out="_lo", rows=rows)
        return lo.withColumn(ts, F.col("_t")).withColumn(
            out, (F.col("_hi") - F.col("_lo")) / (2 * half_step)).drop("_t", "_hi", "_lo")
    grp = by or ["_all"]
    if not by:
        keys, tide = keys.withColumn("_all", F.lit(0)), tide.withColumn("_all", F.lit(0))
    one = F.lit(1).cast("long")
    pt = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    table = ordered(tide, grp, ts, [Scan("_i", one, "sum"), Scan("_p", pt, "prev"), Scan("_f", pt, "follow")], bounded, rows)
    size = tide.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"))
    table = join_groups(table, size, grp).select(*grp, F.col(ts).alias("_x"), F.lit(1).alias("_is_point"), F.when(
        (F.col("_i") >= 3) & (F.col("_i") <= F.col("_n") - 2),
        safe_div(F.col("_f.v") - F.col("_p.v"), F.col("_f.t") - F.col("_p.t"))).alias("_r"))
    keep = [c for c in keys.columns if c != "_all"]
    k = keys.select(*grp, F.col(ts).alias("_x"), F.lit(0).alias("_is_point"), F.struct(*keep).alias("_row"))
    boxed = table.withColumn("_r", F.struct(F.col("_r").alias("v")))
    both = k.unionByName(boxed, allowMissingColumns=True)
    # The key sorts before a sample at the same time, which is then the next one.
    got = ordered(both, grp, ["_x", "_is_point"], [Scan("_nx", F.col("_r"), "next")], bounded, rows)
    return got.where("_is_point = 0").select("_row.*", F.col("_nx.v").alias(out))
