"""Whitening of embeddings by a covariance over distinct vectors with multiplicities.

Vectors are rounded to whole numbers, so many rows share one vector. Rows are
grouped by it first; the sums, the centred covariance and the projections are worked out once per
distinct vector, weighted by its number of rows, and joined back to the rows. Sums of
whole numbers are exact, so centring costs no digits. Partial results of the tasks are
added up on the executors; what reaches the driver is one matrix of dim x dim numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import join_hot, written
from echofold.llm.registry import query, table
from echofold.llm.vectors import dimension, matrix

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Partial sums of this many tasks are added together before the last addition.
FOLD = 256
#: Entries up to this stay whole numbers as doubles, also times a thousand.
LIMIT = 2.0 ** 43


def _whole(dim: int, scale: float, shift: int):
    def run(batches):
        for b in batches:
            rows, at = matrix(b.column(1), dim)
            x = np.floor(scale * rows)
            near = (np.abs(x) <= LIMIT).all(axis=1)
            x = (x[near] + shift).astype("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[near])), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "x"])
    return run


def _unpacked(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(b.num_rows, dim)


def _sums(dim: int):
    """Weighted sums of each dimension, exact whatever their size, and the weight as dimension -1."""
    def run(batches):
        total, weight = [0] * dim, 0
        for b in batches:
            x, w = _unpacked(b, dim), b.column(1).to_numpy()
            if len(x) and int(np.abs(x).max(initial=0)) * int(w.sum()) < 2**62:
                part = (w @ x).tolist()
            else:
                part = (w.astype(object) @ x.astype(object)).tolist() if len(x) else [0] * dim
            total, weight = [s + p for s, p in zip(total, part, strict=True)], weight + int(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(s) for s in [weight, *total]])], ["k", "s"])
    return run


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n with the whole part of S/n taken off as whole numbers."""
    return (x - base).astype(np.float64) - rest


def _products(dim: int, base: np.ndarray, rest: np.ndarray):
    """Weighted products of centred vectors: one row per dimension, of each task."""
    def run(batches):
        c = np.zeros((dim, dim))
        for b in batches:
            d = _centred(_unpacked(b, dim), base, rest)
            c += (d * b.column(1).to_numpy()[:, None]).T @ d
        task = TaskContext.get().partitionId() % FOLD
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([task] * dim, pa.int32()), pa.array(list(c), pa.list_(pa.float64()))], ["i", "task", "v"])
    return run


def _added(keys: int):
    def run(t):
        total = np.concatenate([np.asarray(v.flatten()) for v in t.column("v").chunks]).reshape(t.num_rows, -1).sum(axis=0)
        return pa.table([*[t.column(i).slice(0, 1) for i in range(keys)], pa.array([total], pa.list_(pa.float64()))], names=[*t.column_names[:keys], "v"])
    return run


def _project(dim: int, n: int, total: list[int], base: np.ndarray, rest: np.ndarray, load: np.ndarray):
    """Whitened coordinates and the exact deviation of each distinct vector."""
    def run(batches):
        for b in batches:
            x = _unpacked(b, dim)
            apart = _centred(x, base, rest)
            y = apart @ load
            if n * np.sqrt((apart * apart).sum(axis=1).max(initial=0.0)) < 2.0**31 and n * (np.abs(x).max(initial=0) + 1) < 2**62:
                e = n * x - np.array(total, np.int64)
                dev = [int(v) for v in (e * e).sum(axis=1)]
            else:
                dev = [sum((n * int(v) - s) ** 2 for v, s in zip(r, total, strict=True)) for r in x]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([str(v) for v in dev]), pa.array(list(y), pa.list_(pa.float64()))], ["x", "w", "n_rows", "deviation", "y"])
    return run


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT,
           weights: str = "count") -> DataFrame:
    """Whitened coordinates of every row: vec_id, n, deviation (text of a whole number), whitened (array), explained (array), identity_error.

    weights: 'count' fits over all rows, 'one' over distinct vectors. The k-th coordinate is
    x - S/n projected on the k-th unit eigenvector of the covariance (divisor n), over the root of its eigenvalue.
    The eigenvector's largest entry is positive, the first of several.

    Left out: NULL vectors, vectors with entries that are NULL or not finite or beyond LIMIT once
    scaled, and vectors shorter than the longest. Repeated rows count and come back each; a NULL
    id is kept. A component without variance (to rounding) has NULL coordinates; of fewer dimensions
    than `components` all are used. An empty table gives no rows. Other columns are not read.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"unknown weights {weights!r}")
    src = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    dim = dimension(src, F.col("v"))
    kind = src.schema["vec_id"].dataType.simpleString()
    flat = written(src.mapInArrow(_whole(dim, scale, shift), f"vec_id {kind}, x binary"), "whole")
    classes = flat.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("w", F.col("n_rows") if weights == "count" else F.lit(1).cast("long"))
    classes = written(classes, "classes")
    fit = classes.select("x", "w")
    sums = fit.mapInArrow(_sums(dim), "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["k"]: int(r["s"]) for r in sums.collect()}            # dim + 1 rows
    n = got.get(-1, 0)
    schema = f"vec_id {kind}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"
    if not n or not dim:
        return rows.sparkSession.createDataFrame([], schema)
    total = [got[k] for k in range(dim)]
    base = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    part = fit.mapInArrow(_products(dim, base, rest), "i int, task int, v array<double>")
    part = part.groupBy("i", "task").applyInArrow(_added(2), "i int, task int, v array<double>").drop("task")
    part = part.groupBy("i").applyInArrow(_added(1), "i int, v array<double>")
    cov = np.zeros((dim, dim))
    for r in part.collect():                                       # dim rows
        cov[r["i"]] = r["v"]
    cov = (cov + cov.T) / (2 * n)
    value, vec = np.linalg.eigh(cov)
    value, vec = value[::-1], vec[:, ::-1]
    k = min(components, dim)
    vec = vec * np.where(vec[np.abs(vec).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    there = value[:k] > dim * np.finfo(float).eps * max(trace, 0.0)
    load = np.where(there, vec[:, :k] / np.sqrt(np.where(there, value[:k], 1.0)), 0.0)
    done = written(classes.select("x", "w", "n_rows").mapInArrow(
        _project(dim, n, total, base, rest, load), "x binary, w long, n_rows long, deviation string, y array<double>"), "whitened")
    error = _identity_error(done, [i for i in range(k) if there[i]], n)
    explained = [float(v) / trace if trace > 0 else None for v in value[:k]]
    y = F.array(*[F.col("y")[i] if there[i] else F.lit(None).cast("double") for i in range(k)])
    made = done.select("x", "n_rows", "deviation", y.alias("y"))
    n_rows = int(done.agg(F.sum("n_rows")).first()[0])
    return join_hot(flat, made, "x", "n_rows", n_rows).select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.col("y").alias("whitened"),
        F.array(*[F.lit(v).cast("double") for v in explained]).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _identity_error(done: DataFrame, used: list[int], n: int) -> float | None:
    """Largest entry of the whitened covariance minus the identity, over the components that have variance."""
    if not used:
        return None
    w, y = F.col("w").cast("double"), {i: F.col("y")[i] for i in used}
    mean = done.agg(*[F.sum(w * y[i]).alias(f"m{i}") for i in used]).first()
    d = {i: y[i] - F.lit(mean[f"m{i}"] / n) for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    got = done.agg(*[F.sum(w * d[i] * d[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    """One row per vector and component. A deviation beyond a long is NULL, and so is a coordinate without variance."""
    w = whiten(table(spark, sf_dir, "embeddings"))
    w = w.withColumn("_c", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained")))
    return w.select("vec_id", "_c.component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "_c.whitened", "_c.explained", "identity_error")
