"""Ordered computations over groups of any size.

A group too large for one task is cut into tiles along its order, each tile is scanned on its
own, and one summary row per tile carries the running state across tiles: a tile is the
largest piece of work. The cuts come from a sample of the places; rows are never written
on the way, they are exchanged once by group and tile. Only a caller who knows that groups are
small (`bounded=True`) saves the count of the groups. NULL is a group like any other, so all
joins on groups are null-safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from echofold.params import ROWS_PER_TILE
from echofold.session import cut_lineage

#: Sampled places for each tile, and the most cuts of all groups together.
PER_TILE, MOST_CUTS = 16, 200_000
TILE = "_tile"
HALO = "_halo"


@dataclass(frozen=True)
class Scan:
    """One running quantity.

    kind: 'sum'    running sum up to and including the row
          'max', 'min'  running extremes, including the row
          'last'   last non-null value at or before the row
          'next'   first non-null value at or after the row
          'prev'   value of the row before (NULL kept if that row holds NULL)
          'follow' value of the row after
          'past'   last non-null value strictly before the row
          'ahead'  first non-null value strictly after the row
    """

    name: str
    expr: Column
    kind: str


def _names(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _backward(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])


def _running(w: WindowSpec) -> tuple[WindowSpec, WindowSpec]:
    """Growing frames up to the row and up to the one before it.

    Looking ahead uses a backward window: a frame that shrinks from the end
    would be worked out anew for every row.
    """
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on group keys, NULL equal to NULL; the keys of the left side stay."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(r, on, how).drop(*[f"_r_{c}" for c in keys])


def cuts(df: DataFrame, by, order, rows: int = ROWS_PER_TILE) -> DataFrame | None:
    """Where groups of more than `rows` rows are cut: by, _cut_places (chunks of places in order); None if there is no such group.

    A place is the struct of all order columns, so a value that many rows share is cut by the columns
    after it. The places come from a sample of those groups alone, PER_TILE for each tile, sorted
    per group; all rows are taken where that is as many. There are at most MOST_CUTS cuts, for which tiles grow
    beyond `rows` if they have to. Only this table is computed and checkpointed here: tiles are a
    function of the row and these cuts, so no lost executor can mix two sets of them.
    """
    by, order = _names(by), _names(order)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total, top = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if top is None or top <= rows:
        return None
    rows = max(rows, -(-2 * total // MOST_CUTS))
    large = cut_lineage(sizes.where(F.col("_n") > rows))                     # fewer than MOST_CUTS / 2 rows
    share = 2 * PER_TILE / rows
    keys = df.select(*by, F.struct(*order).alias("_at"))
    picked = join_groups(keys if share > 0.5 else keys.sample(share, seed=17), F.broadcast(large), by)
    per = picked.groupBy(*by).agg(F.array_sort(F.collect_list("_at")).alias("_s"), F.first("_n").alias("_n"))
    m = F.ceil(2 * F.col("_n") / rows)
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), m - 1)), lambda i: F.element_at(
        "_s", F.greatest(F.lit(1), F.floor(i * F.size("_s") / m)).cast("int"))))
    per = per.select(*by, places.alias("_p")).withColumn("_k", F.ceil(F.sqrt(F.size("_p"))).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_p") - 1) / F.col("_k")).cast("int")), lambda c: F.slice("_p", c * F.col("_k") + 1, F.col("_k")))
    return cut_lineage(per.select(*by, chunks.alias("_cut_places")))


def cut_at(df: DataFrame, by, order, where: DataFrame | None) -> DataFrame:
    """Add the tile number: how many cuts of its group lie below a row. The chunk is looked up first, then the place within it."""
    by, order = _names(by), _names(order)
    if where is None:
        return df.withColumn(TILE, F.lit(0).cast("long"))
    at = F.struct(*order)
    d = join_groups(df, F.broadcast(where), by, "left").withColumn("_cut_chunk", F.size(F.filter("_cut_places", lambda c: F.get(c, F.lit(0)) < at)))
    inner = F.size(F.filter(F.get("_cut_places", F.col("_cut_chunk") - 1), lambda p: p < at))
    tile = F.when(F.col("_cut_chunk") > 0, (F.col("_cut_chunk") - 1) * F.size(F.get("_cut_places", F.lit(0))) + inner).otherwise(0)
    return d.withColumn(TILE, tile.cast("long")).drop("_cut_places", "_cut_chunk")


def tile(df: DataFrame, by, order, rows: int = ROWS_PER_TILE) -> DataFrame:
    """Add a tile number, increasing along `order` within each group; a tile has about rows / 2 rows.

    Rows that agree in all order columns have no order and stay together; NULL places come first.
    """
    return cut_at(df, by, order, cuts(df, by, order, rows))


def settle(df: DataFrame, by, order, bounded: bool = False, rows: int = ROWS_PER_TILE) -> tuple[DataFrame, bool]:
    """The frame with tiles, once for all scans to come, and whether plain windows do because no group needs any."""
    if bounded or TILE in df.columns:
        return df, bounded
    where = cuts(df, by, order, rows)
    return (df, True) if where is None else (cut_at(df, by, order, where), False)


def scan(df: DataFrame, by, order, specs: list[Scan], rows: int = ROWS_PER_TILE) -> DataFrame:
    """Add the running quantities `specs`, ordered by `order` within `by`.

    `order` is one column or a list, the later ones break ties. A frame that is
    tiled already keeps its tiles. NULL orders come first, as in a window. Where no group has
    more than `rows` rows there is one tile each and nothing to carry, which is a plain window.
    """
    by, order = _names(by), _names(order)
    t, plain = settle(df, by, order, False, rows)
    if plain:
        return ordered(df, by, order, specs, True)
    key = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    w = Window.partitionBy(*by, TILE).orderBy(*order)
    up, before = _running(w)
    down, after = _running(_backward([*by, TILE], order))
    _, c_before = _running(Window.partitionBy(*by).orderBy(TILE))
    _, c_after = _running(_backward(by, [TILE]))

    local, totals, carries = [], [], []
    for i, s in enumerate(specs):
        loc, tot, car = f"_l{i}", f"_t{i}", f"_c{i}"
        held = F.when(s.expr.isNotNull(), key)
        boxed = F.struct(s.expr.alias("v"))
        if s.kind in ("sum", "max", "min"):
            f = {"sum": F.sum, "max": F.max, "min": F.min}[s.kind]
            local.append(f(s.expr).over(up).alias(loc))
            totals.append(f(s.expr).alias(tot))
            carries.append(f(tot).over(c_before).alias(car))
        elif s.kind in ("last", "past"):
            local.append(F.last(s.expr, True).over(up if s.kind == "last" else before).alias(loc))
            totals.append(F.max_by(s.expr, held).alias(tot))
            carries.append(F.last(tot, True).over(c_before).alias(car))
        elif s.kind in ("next", "ahead"):
            local.append(F.last(s.expr, True).over(down if s.kind == "next" else after).alias(loc))
            totals.append(F.min_by(s.expr, held).alias(tot))
            carries.append(F.last(tot, True).over(c_after).alias(car))
        elif s.kind == "prev":
            local.append(F.lag(boxed).over(w).alias(loc))
            totals.append(F.max_by(boxed, key).alias(tot))
            carries.append(F.last(tot, True).over(c_before).alias(car))
        elif s.kind == "follow":
            local.append(F.lead(boxed).over(w).alias(loc))
            totals.append(F.min_by(boxed, key).alias(tot))
            carries.append(F.last(tot, True).over(c_after).alias(car))
        else:
            raise ValueError(f"unknown scan kind {s.kind!r}")

    summary = t.groupBy(*by, TILE).agg(*totals).select(*by, TILE, *carries)
    out = join_groups(t.select("*", *local), summary, by + [TILE])
    cols = []
    for i, s in enumerate(specs):
        loc, car = F.col(f"_l{i}"), F.col(f"_c{i}")
        if s.kind == "sum":
            v = F.coalesce(loc + car, loc, car)
        elif s.kind == "max":
            v = F.greatest(loc, car)
        elif s.kind == "min":
            v = F.least(loc, car)
        elif s.kind in ("prev", "follow"):
            v = F.coalesce(loc, car)["v"]
        else:
            v = F.coalesce(loc, car)
        cols.append(v.alias(s.name))
    return out.select(*df.columns, *cols)


def moving(df: DataFrame, by, axis: str, aggs: dict[str, Column | tuple], before: int, after: int,
           width: int = 4096) -> DataFrame:
    """Aggregates over rows whose integer `axis` lies within [axis-before, axis+after].

    Tiles of `width` axis steps, each with a halo of neighbours, so a long axis
    is never one window partition. `aggs` maps a name to an aggregate column.
    """
    by = _names(by)
    width = max(width, before + after + 1)
    here = F.floor(F.col(axis) / width)
    first, last = F.floor((F.col(axis) - after) / width), F.floor((F.col(axis) + before) / width)
    wide = df.withColumn(HALO, F.explode(F.coalesce(F.sequence(first, last), F.array(F.lit(None).cast("bigint"))))).withColumn("_core", F.col(HALO).eqNullSafe(here))
    w = Window.partitionBy(*by, HALO).orderBy(F.col(axis).cast("long")).rangeBetween(-before, after)
    out = wide.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.where("_core").drop(HALO, "_core")


def rows_around(df: DataFrame, by, order, aggs: dict[str, Column], before: int, after: int,
                rows: int = ROWS_PER_TILE, bounded: bool = False) -> DataFrame:
    """Like `moving`, by row position along `order` instead of an integer axis."""
    by, order = _names(by), _names(order)
    if bounded:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    numbered = scan(df, by, order, [Scan("_pos", F.lit(1).cast("long"), "sum")], rows)
    return moving(numbered, by, "_pos", aggs, before, after, width=max(rows // 4, 1024)).drop("_pos")


def ordered(df: DataFrame, by, order, specs: list[Scan], bounded: bool = False,
            rows: int = ROWS_PER_TILE) -> DataFrame:
    """`scan`, or the plain window for a caller who knows that every group fits one task.

    bounded=True says so by construction: a trace has as many samples as the
    fast-time axis, a line as many passes as it was driven.
    """
    if not bounded:
        return scan(df, by, order, specs, rows)
    by, order = _names(by), _names(order)
    w = Window.partitionBy(*by).orderBy(*order)
    up, before = _running(w)
    down, after = _running(_backward(by, order))
    made = {
        "sum": lambda e: F.sum(e).over(up), "max": lambda e: F.max(e).over(up), "min": lambda e: F.min(e).over(up),
        "last": lambda e: F.last(e, True).over(up), "next": lambda e: F.last(e, True).over(down),
        "past": lambda e: F.last(e, True).over(before), "ahead": lambda e: F.last(e, True).over(after),
        "prev": lambda e: F.lag(e).over(w), "follow": lambda e: F.lead(e).over(w),
    }
    return df.select("*", *[made[s.kind](s.expr).alias(s.name) for s in specs])


def spread_over(df: DataFrame, by, aggs: dict[str, Column], bounded: bool) -> DataFrame:
    """Attach per-group aggregates to every row: a window for bounded groups, else aggregate and join."""
    by = _names(by)
    if bounded:
        w = Window.partitionBy(*by)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return join_groups(df, df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]), by)
