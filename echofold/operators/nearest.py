"""Nearest positions in the plane by a tree of cells, for any distance and any crowding.

Positions fall into cells of a square that FAN x FAN finer ones replace wherever a cell holds more
than `cap` positions; every cell knows its count and the box its positions really fill.
A search goes down the tree one level a round, for all queries at once: joins on the
parent cell put each query beside the cells that may still hold its nearest position,
those whose box is not farther than the farthest corner of another box. Work follows
the few cells near a query, not queries x positions: a query far off every position
keeps as few cells as one among them, and a crowded cell is cut until it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.operators.scan import join_groups
from echofold.session import cut_lineage

FAN = 8
CAP = 64
DEEPEST = 15


@dataclass(frozen=True)
class CellTree:
    points: DataFrame
    by: list[str]
    x: str
    y: str
    origin: tuple[float, float, float]
    levels: list[DataFrame]


def _cell(c: Column, start: float, side: float, level: int) -> Column:
    return F.floor((c - F.lit(start)) * F.lit(FAN**level / side)).cast("long")


def _placed(t: DataFrame, x: str, y: str, origin, level: int) -> DataFrame:
    x0, y0, side = origin
    return t.withColumn("_ix", _cell(F.col(x), x0, side, level)).withColumn("_iy", _cell(F.col(y), y0, side, level))


def cell_tree(points: DataFrame, x: str, y: str, by=(), half: Column | None = None, cap: int = CAP) -> CellTree | None:
    """The tree of each group; None without positions. Positions that are NULL or not finite are left out.

    `half` is an allowance of each position that a search adds to its radius. A level costs one pass over
    the positions, summed up map-side by cell; only cells of crowded parents are kept. The
    tables of the levels are checkpointed. Positions at one place are never cut.
    """
    by = list(by)
    ok = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    known = points.where(ok(x) & ok(y)).withColumn("_half", half if half is not None else F.lit(0.0))
    x0, x1, y0, y1 = known.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if x0 is None:
        return None
    origin = (float(x0), float(y0), max(float(x1 - x0), float(y1 - y0), 1e-300) * (1 + 1e-9))
    levels = []
    for level in range(DEEPEST + 1):
        cells = _placed(known, x, y, origin, level).groupBy(*by, "_ix", "_iy").agg(
            F.count(F.lit(1)).alias("_n"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.max("_half").alias("_h"))
        cells = cells.withColumn("_px_", F.floor(F.col("_ix") / FAN)).withColumn("_py_", F.floor(F.col("_iy") / FAN))
        if levels:
            parents = levels[-1].where("not _leaf").select(*by, F.col("_ix").alias("_px_"), F.col("_iy").alias("_py_"), F.lit(1).alias("_in"))
            cells = join_groups(cells, parents, [*by, "_px_", "_py_"]).drop("_in")
        leaf = (F.col("_n") <= cap) | ((F.col("_x0") == F.col("_x1")) & (F.col("_y0") == F.col("_y1"))) | F.lit(level == DEEPEST)
        levels.append(cut_lineage(cells.withColumn("_leaf", leaf)))
        if levels[-1].where("not _leaf").isEmpty():
            break
    return CellTree(known, by, x, y, origin, levels)


def near_pairs(queries: DataFrame, tree: CellTree, key: list[str], qx: str, qy: str, others: bool = False, within: float | None = None) -> DataFrame:
    """Each query beside positions among which is its nearest, and any within its distance plus the position's allowance.

    `key` identifies a query within its group. others=True is for queries that are positions themselves, each once: the
    nearest other one is meant. `within` bounds the distance. Output: the columns of the query, those of
    the position (under `point`), and gap.
    """
    by = tree.by
    d = join_groups(queries.withColumn("_u", F.lit(float("inf") if within is None else float(within))), tree.levels[0], by)
    parts = []
    for level, cells in enumerate(tree.levels):
        if level:
            d = join_groups(d.select(*queries.columns, "_u", F.col("_ix").alias("_px_"), F.col("_iy").alias("_py_")), cells, [*by, "_px_", "_py_"])
        px, py = F.col(qx), F.col(qy)
        gap = lambda lo, hi, p: F.greatest(F.col(lo) - p, p - F.col(hi), F.lit(0.0))
        far = lambda lo, hi, p: F.greatest(F.abs(F.col(lo) - p), F.abs(F.col(hi) - p))
        d = d.withColumn("_lo", F.hypot(gap("_x0", "_x1", px), gap("_y0", "_y1", py))).withColumn("_hi", F.hypot(far("_x0", "_x1", px), far("_y0", "_y1", py)))
        sure = F.col("_n") >= (2 if others else 1)
        one = Window.partitionBy(*by, *key)                     # the cells of one query: a few
        d = d.withColumn("_u", F.least("_u", F.coalesce(F.min(F.when(sure, F.col("_hi"))).over(one), F.lit(float("inf")))))
        d = cut_lineage(d.where(F.col("_lo") <= (F.col("_u") + F.col("_h")) * (1 + 1e-12)))
        at = d.where("_leaf").select(*queries.columns, "_u", "_ix", "_iy")
        held = _placed(tree.points, tree.x, tree.y, tree.origin, level)
        held = held.select(*by, "_ix", "_iy", F.struct(*tree.points.columns).alias("point"))
        pair = join_groups(at, held, [*by, "_ix", "_iy"])
        pair = pair.withColumn("gap", F.hypot(F.col(f"point.{tree.x}") - px, F.col(f"point.{tree.y}") - py))
        parts.append(pair.where(F.col("gap") <= (F.col("_u") + F.col("point._half")) * (1 + 1e-12)).select(*queries.columns, "point", "gap"))
        d = d.where("not _leaf")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
