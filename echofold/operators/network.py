"""Pair networks: epoch values from differences, components, chains and loop closure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions.columns import field
from echofold.operators.scan import Scan, ordered
from echofold.params import MAD_SCALE, NOISE_FLOOR, ROWS_PER_TILE
from echofold.session import cut_lineage


def _reachable(link: np.ndarray) -> np.ndarray:
    """Largest connected component of each graph of a batch (b, n, n): the one with the smallest node on a tie."""
    n = link.shape[1]
    reach = link | np.eye(n, dtype=bool)
    for _ in range(max(1, int(np.ceil(np.log2(n))))):
        reach = np.matmul(reach.astype(np.float32), reach.astype(np.float32)) > 0
    root = reach.sum(axis=2).argmax(axis=1)
    return reach[np.arange(len(link)), root] & link.any(axis=2)


def _balance(i: np.ndarray, j: np.ndarray, y: np.ndarray, w: np.ndarray, n: int):
    """Weighted least squares of a batch of networks over the same pairs, from their graph Laplacians.

    y, w are (b, pairs), w = 0 for a pair that is out. Of each network the largest
    component has values that add up to zero: L + ones/m is regular on it and has the same
    solution. Returns x, sd (NaN off the component), residuals, and which pairs and nodes took part.
    """
    rows = np.arange(len(y))[:, None]
    weight = np.zeros((len(y), n, n))
    np.add.at(weight, (rows, i[None], j[None]), w)
    weight = weight + weight.transpose(0, 2, 1)
    nodes = _reachable(weight > 0)
    part = (w > 0) & nodes[:, i] & nodes[:, j]
    u = np.where(part, w, 0.0)
    lap, flow = np.zeros((len(y), n, n)), np.zeros((len(y), n))
    for a, c, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
        np.add.at(lap, (rows, a[None], c[None]), sign * u)
    np.add.at(flow, (rows, j[None]), u * np.where(part, y, 0.0))
    np.add.at(flow, (rows, i[None]), -u * np.where(part, y, 0.0))
    m = np.maximum(nodes.sum(axis=1), 1)
    both = nodes[:, :, None] & nodes[:, None, :]
    scale = np.maximum(np.trace(lap, axis1=1, axis2=2) / m, 1e-300)
    full = lap + np.where(both, (scale / m)[:, None, None], 0.0) + np.eye(n) * np.where(nodes, 0.0, scale[:, None])[:, None, :]
    inverse = np.linalg.inv(full)
    x = np.einsum("bij,bj->bi", inverse, flow)
    res = np.where(part, x[:, j] - x[:, i] - y, np.nan)
    free = np.maximum(1, part.sum(axis=1) - (m - 1))
    s2 = np.nansum(u * np.where(part, res, 0.0) ** 2, axis=1) / free
    # The datum's own unit of precision belongs to the design: one row of ones.
    spread = np.einsum("bii->bi", inverse) - (1 / (scale * m))[:, None] + (1 / m**2.0)[:, None]
    sd = np.sqrt(np.abs(s2[:, None] * spread))
    return np.where(nodes, x, np.nan), np.where(nodes, sd, np.nan), res, nodes, part


def _robust(i, j, y, w, n, n_sigma: float, max_iter: int, min_pairs: int):
    """`_balance` with pairs beyond n_sigma scaled MADs taken out round by round; and which networks stand.

    A spread within rounding of the differences is no spread: nothing is rejected there.
    """
    w = np.where(np.isfinite(y) & np.isfinite(w) & (w > 0), w, 0.0)
    y = np.where(w > 0, y, 0.0)
    floor = NOISE_FLOOR * np.abs(y).max(axis=1, keepdims=True, initial=0.0)
    alive = (w > 0).sum(axis=1) >= min_pairs
    moving = alive.copy()
    for _ in range(max_iter):
        at = np.flatnonzero(moving)
        if not len(at):
            break
        _, _, res, _, part = _balance(i, j, y[at], w[at], n)
        mid = np.nanmedian(np.where(part, res, np.nan), axis=1, keepdims=True)
        s = MAD_SCALE * np.nanmedian(np.abs(np.where(part, res, np.nan) - mid), axis=1, keepdims=True)
        bad = part & (s > floor[at]) & (np.abs(res) > n_sigma * s)
        w[at] = np.where(part & ~bad, w[at], 0.0)
        moving[at] = bad.any(axis=1) & ((w[at] > 0).sum(axis=1) >= min_pairs)
        alive[at] &= (w[at] > 0).sum(axis=1) >= min_pairs
    got = _balance(i, j, y, w, n)
    return got, alive & (got[4].sum(axis=1) >= min_pairs)


def invert_network(df: DataFrame, row_key: list[str], i: str, j: str, d: str, w: str | None = None, n_sigma: float = 3.0,
                   max_iter: int = 4, min_pairs: int = 6) -> tuple[DataFrame, DataFrame]:
    """Epoch values x with d(i,j) = x_j - x_i, sum zero, per row; robust against bad pairs.

    Returns (epochs: row, epoch, x, x_std, n_used, n_epoch, rms) and (pairs: row,
    i, j, resid, used). A row's network is at most its passes squared, so it is
    packed into one record; rows are independent and spread over the cluster.
    Pairs beyond n_sigma scaled MADs of zero are rejected round by round, unless
    the MAD is mere rounding (at most NOISE_FLOOR of the largest difference): a network that closes
    exactly keeps all of its pairs. Only the largest connected component is solved;
    other epochs have no row.
    """
    wt = F.col(w) if w else F.lit(1.0)
    packed = df.groupBy(*row_key).agg(F.collect_list(F.struct(
        F.col(i).cast("int").alias("i"), F.col(j).cast("int").alias("j"), F.col(d).cast("double").alias("d"),
        wt.cast("double").alias("w"))).alias("_p"))
    packed = packed.select(*row_key, F.array_sort("_p").alias("_p")).select(
        *row_key, *[F.transform("_p", field(k)).alias(f"_{k}") for k in "ijdw"])
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in row_key) + (
        ", epoch array<int>, x array<double>, x_std array<double>, i array<int>, j array<int>, resid array<double>, "
        "used array<boolean>, n_used int, n_epoch int, rms double")

    names = [*row_key, "epoch", "x", "x_std", "i", "j", "resid", "used", "n_used", "n_epoch", "rms"]

    def solve(batches):
        for pdf in batches:
            out, shapes = [], {}
            for at, rec in enumerate(zip(pdf["_i"], pdf["_j"], strict=True)):
                shapes.setdefault((tuple(rec[0]), tuple(rec[1])), []).append(at)
            # Records with the same pairs share the layout of their matrices and are solved together.
            for (pi, pj), at in shapes.items():
                ids, flat = np.unique(np.array([*pi, *pj]), return_inverse=True)
                a, b = flat[: len(pi)], flat[len(pi):]
                y, wv = (np.array(pdf[c].iloc[at].tolist(), float).reshape(len(at), -1) for c in ("_d", "_w"))
                (x, sd, res, nodes, part), stands = _robust(a, b, y, wv, len(ids), n_sigma, max_iter, min_pairs)
                keys = pdf[row_key].iloc[at].to_numpy(object)
                for k in np.flatnonzero(stands):
                    on, use = nodes[k], part[k]
                    out.append([*keys[k], ids[on].tolist(), x[k][on].tolist(), sd[k][on].tolist(), list(pi), list(pj),
                                [None if np.isnan(v) else float(v) for v in res[k]], use.tolist(), int(use.sum()), int(on.sum()),
                                float(np.sqrt(np.mean(res[k][use] ** 2)))])
            yield pd.DataFrame(out, columns=names)

    sol = packed.mapInPandas(solve, schema)
    z = sol.select(*row_key, "n_used", "n_epoch", "rms", F.explode(F.arrays_zip("epoch", "x", "x_std")).alias("_e"))
    epochs = z.select(*row_key, "_e.epoch", "_e.x", "_e.x_std", "n_used", "n_epoch", "rms")
    p = sol.select(*row_key, F.explode(F.arrays_zip("i", "j", "resid", "used")).alias("_q"))
    return epochs, p.select(*row_key, F.col("_q.i").alias(i), F.col("_q.j").alias(j), "_q.resid", "_q.used")


def complete_network(df: DataFrame, row_key: list[str], i: str, j: str, d: str) -> DataFrame:
    """Closed form for an unweighted complete network: x_j is the mean of d(., j) over all epochs."""
    n = df.groupBy(*row_key).agg(F.countDistinct(i).alias("_n"))
    sides = df.select(*row_key, F.explode(F.array(
        F.struct(F.col(j).alias("epoch"), F.col(d).alias("v")), F.struct(F.col(i).alias("epoch"), (-F.col(d)).alias("v")))).alias("s"))
    g = sides.groupBy(*row_key, F.col("s.epoch").alias("epoch")).agg(F.sum("s.v").alias("_s"))
    return g.join(n, row_key).select(*row_key, "epoch", (F.col("_s") / (F.col("_n") + 1)).alias("x"))


def rejected_pairs(pairs: DataFrame, i: str, j: str, line: list[str], k: int | None = None) -> DataFrame:
    """How many rows rejected each pair, most first, never-rejected pairs left out."""
    n = pairs.groupBy(*line, i, j).agg(F.sum((~F.col("used")).cast("long")).alias("n_rejected")).where("n_rejected > 0")
    return top_k(n, "n_rejected", [*line, i, j], k) if k else n


def top_k(df: DataFrame, score: str, ties: list[str], k: int, positive: bool = True) -> DataFrame:
    """The k largest scores (a partial sort per task, then a merge of k rows each); zeros stop it."""
    d = df.where(F.col(score) > 0) if positive else df
    return d.orderBy(F.col(score).desc(), *ties).limit(k)


def largest_component(pairs: DataFrame, i: str, j: str, by: list[str], max_rounds: int = 60) -> DataFrame:
    """Nodes of the largest connected component per group, smallest node first on a tie.

    Labels fall to the smallest reachable node by joins, two hops of pointer
    jumping a round, until nothing moves; each round is checkpointed, so a lost
    executor repeats one round at most.
    """
    e = pairs.select(*by, F.col(i).alias("a"), F.col(j).alias("b")).where("a <> b").distinct()
    edges = cut_lineage(e.unionByName(e.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = edges.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    label = cut_lineage(label)
    for _ in range(max_rounds):
        near = (edges.join(label.select(*by, F.col("node").alias("b"), "label"), [*by, "b"])
                .groupBy(*by, F.col("a").alias("node")).agg(F.min("label").alias("_near")))
        step = label.join(near, [*by, "node"]).select(*by, "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        far = step.select(*by, F.col("node").alias("label"), F.col("label").alias("_far"))
        step = step.join(far, [*by, "label"]).select(*by, "node", "_old", F.least("label", "_far").alias("label"))
        step = cut_lineage(step)
        moved = step.where("label <> _old").limit(1).count()
        label = step.drop("_old")
        if not moved:
            break
    else:
        raise RuntimeError("component labels did not settle")
    size = label.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_nodes"))
    best = size.groupBy(*by).agg(F.max(F.struct("n_nodes", (-F.col("label")).alias("m"))).alias("s")).select(
        *by, (-F.col("s.m")).alias("label"))
    return label.join(best, [*by, "label"]).select(*by, "node")


def chain_from_reference(steps: DataFrame, ref: DataFrame, by: list[str], bounded: bool = True,
                         rows: int = ROWS_PER_TILE) -> DataFrame:
    """Cumulative sum of sequential steps away from the reference pass, both ways.

    `steps`: by, k, step (pass k to k+1; NULL or absent = missing); `ref`: by,
    ref_idx. A missing step ends the chain on its side. Output: by, pass_idx, chained.
    """
    s = steps.join(ref, by)
    first_k = s.groupBy(*by).agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"), F.first("ref_idx").alias("ref_idx"))
    every = first_k.select(*by, "ref_idx", F.explode(F.sequence("_lo", "_hi")).alias("k"))
    full = every.join(steps.select(*by, "k", "step"), [*by, "k"], "left")
    fwd = full.where("k >= ref_idx").select(*by, "ref_idx", (F.col("k") + 1).alias("pass_idx"), "k", "step")
    back = full.where("k < ref_idx").select(*by, "ref_idx", F.col("k").alias("pass_idx"), (-F.col("k")).alias("k"), (-F.col("step")).alias("step"))
    both = fwd.withColumn("_side", F.lit(1)).unionByName(back.withColumn("_side", F.lit(-1)))
    run = ordered(both, [*by, "_side"], "k", [
        Scan("_sum", F.col("step"), "sum"), Scan("_gaps", F.col("step").isNull().cast("int"), "sum")], bounded, rows)
    chained = run.where("_gaps = 0").select(*by, "pass_idx", F.col("_sum").alias("chained"))
    return chained.unionByName(first_k.select(*by, F.col("ref_idx").alias("pass_idx"), F.lit(0.0).alias("chained")))


def loop_closure(direct: DataFrame, chained: DataFrame, by: list[str], min_n: int = 4) -> DataFrame:
    """Direct minus chained difference: mean, rms, worst, correlation with |dt| and slope on dt.

    `direct`: by, pass_idx, value, dt.
    """
    j = direct.join(chained, [*by, "pass_idx"]).withColumn("c", F.col("value") - F.col("chained"))
    j = j.where(F.col("c").isNotNull() & F.col("dt").isNotNull())
    g = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.sqrt(F.avg(F.col("c") * F.col("c"))).alias("rms"),
        F.max(F.abs("c")).alias("worst"), F.corr(F.abs("dt"), F.col("c")).alias("r_abs_dt"), F.regr_slope("c", "dt").alias("slope"))
    return g.where(F.col("n") >= min_n)
