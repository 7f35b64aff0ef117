"""Hard negatives by angular triangle filtering.

Vectors become whole numbers, scores are whole inner products. Every row knows its angles to a
few reference directions. The angle between two vectors is at least the difference and at
most the sum of their angles to any direction; so a window of rows, for which the least and
largest angles and norms are stored, gives an interval of cosines, and times the norms an
interval of scores. It is widened by more than rounding can do. Only windows whose
interval meets what an anchor still looks for get the exact scores, in one matrix product.

Rows are sorted by (label, reference, angle) and cut into windows of WINDOW rows, stored as the table
`angle-windows`; anchors stand in the same order, so a block of them has few
labels. Anchors in blocks of BLOCK meet windows in at most SLICES slices: one task is one
block and one slice, it holds the anchors and reads the windows as a stream. Every task keeps the best
few of each anchor, ties by id, so a vector that many rows share fills no list. First the
positives of all anchors are found, beginning from those in an anchor's own window, then the negatives
in the score ranges of the positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.llm.common import small_batches, written
from echofold.llm.registry import query, table
from echofold.llm.vectors import dimension, matrix

SCALE = 256
TOP = 5
LEAST, MOST = 80, 100
REFERENCES = 16
#: Rows the reference directions are fitted on, those with the smallest hash of their id.
SAMPLE, SAMPLE_BYTES = 10_000, 64 << 20
WINDOW = 256
#: Rows of a part of the window table, and the most parts.
PART_ROWS, MOST_PARTS = 8192, 16_384
BLOCK, SLICES = 16_384, 256
#: Hits that are held at least before they are reduced to the best of each list.
HELD = 1 << 16
#: Radians and share of a score that bounds are widened by.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
#: Beyond every score and id.
ABOVE, FAR = 2**62 + 1, np.iinfo(np.int64).max


def limit(dim: int) -> float:
    """Largest entry with which a score is sure to fit a long."""
    return min(2.0**30, np.sqrt(2.0**62 / max(dim, 1)))


# --- angles and bounds ------------------------------------------------------

def angles(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references; a zero vector is at right angles to all."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    c = x @ refs.T / np.where(norm > 0, norm, 1.0)[:, None]
    return norm, np.arccos(np.clip(c, -1.0, 1.0))


def score_bounds(norm, angle, w_norm, w_angle) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with any row of a window: (anchors,) each.

    `w_norm` = (least, largest), `w_angle` = (least, largest) per reference.
    """
    lo, hi = w_angle
    apart = np.maximum(np.maximum(lo - angle, angle - hi), 0.0).max(axis=1, initial=0.0)
    near = np.maximum(apart - ANGLE_SLACK, 0.0)
    both = np.minimum(angle + hi, 2 * np.pi - angle - lo).min(axis=1, initial=np.pi)
    far = np.minimum(both + ANGLE_SLACK, np.pi)
    top, low = np.cos(near), np.cos(far)
    slack = norm * w_norm[1] * SCORE_SLACK + 1e-3
    return (norm * np.where(low < 0, w_norm[1], w_norm[0]) * low - slack,
            norm * np.where(top < 0, w_norm[0], w_norm[1]) * top + slack)


def scores(a: np.ndarray, x: np.ndarray, a_norm: float, x_norm: float) -> np.ndarray:
    """Exact inner products: as floats while every partial sum is a whole number they can hold, else as longs."""
    for bound, kind in ((2.0**24, np.float32), (2.0**53, np.float64)):
        if a_norm * x_norm < bound:
            return a.astype(kind, copy=False) @ x.astype(kind, copy=False).T
    return a.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The best `top` (score, id) of each of n lists: higher scores first, ties by smaller id; a pair counts once."""

    def __init__(self, n: int, top: int, least: np.ndarray):
        self.top, self.score, self.id, self.most = top, least.copy(), np.full(n, FAR), max(HELD, 4 * n * top)
        self.kept, self.held, self.size = tuple(np.zeros(0, np.int64) for _ in range(3)), [], 0

    def offer(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = score.astype(np.int64)
        better = (score > self.score[which]) | ((score == self.score[which]) & (ids <= self.id[which]))
        if better.any():
            self.held.append((which[better], score[better], ids[better]))
            self.size += len(self.held[-1][0])
            if self.size > self.most:
                self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, s, i = (np.concatenate([k, *[h[c] for h in self.held]]) for c, k in enumerate(self.kept))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        w, s, i = w[new], s[new], i[new]
        rank = np.arange(len(w)) - np.searchsorted(w, w, "left")
        last = rank == self.top - 1
        self.score[w[last]], self.id[w[last]] = s[last], i[last]
        keep = rank < self.top
        self.kept, self.held, self.size = (w[keep], s[keep], i[keep]), [], 0
        return self.kept


# --- rows, windows, anchors -------------------------------------------------

def _whole(dim: int, scale: float, refs: np.ndarray | None):
    """Rows that take part: whole numbers, and with references the nearest one and its angle."""
    def run(batches):
        for b in batches:
            rows, at = matrix(b.column(2), dim)
            x = np.floor(scale * rows)
            fits = (np.abs(x) <= limit(dim)).all(axis=1)
            x, at = x[fits].astype("<i4"), pa.array(at[fits])
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array([r.tobytes() for r in x], pa.binary())]
            if refs is not None:
                _, t = angles(x, refs)
                ref = t.argmin(axis=1)
                cols += [pa.array(ref, pa.int32()), pa.array(t[np.arange(len(t)), ref])]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "x", "ref", "angle"][:len(cols)])
    return run


def _directions(sample: np.ndarray, k: int) -> np.ndarray:
    """The k directions along which the vectors of a sample differ most."""
    dim = sample.shape[1]
    if not dim or not len(sample):
        return np.zeros((0, dim))
    norm = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = sample / np.where(norm > 0, norm, 1.0)
    return np.ascontiguousarray(np.linalg.eigh(unit.T @ unit)[1][:, ::-1][:, :k].T)


_MADE = ("anchor boolean, part int, pos int, vec_id long, label long, x binary, seed long, n int, width int, ids binary, labels binary, "
         "norm_lo double, norm_hi double, angle_lo array<double>, angle_hi array<double>, label_lo long, label_hi long")
_FIELDS = pa.schema([("anchor", pa.bool_()), ("part", pa.int32()), ("pos", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()), ("seed", pa.int64()),
                     ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("norm_lo", pa.float64()), ("norm_hi", pa.float64()),
                     ("angle_lo", pa.list_(pa.float64())), ("angle_hi", pa.list_(pa.float64())), ("label_lo", pa.int64()), ("label_hi", pa.int64())])


def _seed(score: np.ndarray, ids: np.ndarray, top: int) -> int:
    """The top-th best score of rows with different ids, a floor for the whole table's."""
    best = np.unique(np.stack([score.astype(np.int64), ids]), axis=1)[0]
    return int(np.sort(best)[-top]) if len(best) >= top else -ABOVE


def _windows(dim: int, refs: np.ndarray, every: int, top: int):
    """Sorted rows of a part to windows, and the anchors among them with what their own window promises."""
    def close(part: int, pos: int, ids, labels, x, last):
        norm, t = angles(x, refs)
        small = int(np.abs(x).max(initial=0)) < 2**15
        out = [{"anchor": False, "part": part, "pos": pos, "x": x.astype("<i2" if small else "<i4").tobytes(), "n": len(ids), "width": 2 if small else 4,
                "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "norm_lo": norm.min(), "norm_hi": norm.max(),
                "angle_lo": t.min(axis=0), "angle_hi": t.max(axis=0), "label_lo": labels.min(), "label_hi": labels.max()}]
        mine = np.flatnonzero(ids % every == 0)
        if len(mine):
            s = scores(x[mine], x, norm.max(), norm.max())
        for row, at in enumerate(mine):
            me = (int(ids[at]), int(labels[at]), x[at].astype("<i4").tobytes())
            if me == last:                              # a repeated row is one anchor
                continue
            last = me
            use = (labels == labels[at]) & (ids != ids[at])
            out.append({"anchor": True, "part": part, "pos": pos, "vec_id": me[0], "label": me[1], "x": me[2], "seed": _seed(s[row][use], ids[use], top)})
            pos += 1
        return out, pos, last

    def run(batches):
        part, pos, last = TaskContext.get().partitionId(), 0, None
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim), np.int32)]
        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4").reshape(b.num_rows, dim)]
            held = [np.concatenate([h, v]) for h, v in zip(held, new, strict=True)]
            out = []
            while len(held[0]) >= WINDOW:
                got, pos, last = close(part, pos, *[h[:WINDOW] for h in held], last)
                out, held = out + got, [h[WINDOW:] for h in held]
            if out:
                yield pa.RecordBatch.from_pylist(out, _FIELDS)
        if len(held[0]):
            yield pa.RecordBatch.from_pylist(close(part, pos, *held, last)[0], _FIELDS)
    return run


# --- search -----------------------------------------------------------------

class _Anchors:
    """The anchors of one task, and the lists they fill."""

    def __init__(self, rows: list[dict], dim: int, refs: np.ndarray, top: int, least: int | None, most: int):
        self.no = np.array([r["no"] for r in rows], np.int64)
        self.id, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label"))
        self.x = np.frombuffer(b"".join(r["x"] for r in rows), "<i4").reshape(len(rows), dim)
        self.norm, self.angle = angles(self.x, refs)
        self.positives = least is None
        if self.positives:
            self.width, self.low = 1, np.array([[r["seed"]] for r in rows], np.int64)
            self.high = np.full((len(rows), 1), ABOVE)
        else:                                           # whole scores from least % to most % of each positive's
            self.width = top
            self.low, self.high = np.full((len(rows), top), ABOVE), np.full((len(rows), top), -ABOVE)
            for k, r in enumerate(rows):
                for i, s in enumerate(r["scores"]):
                    self.low[k, i], self.high[k, i] = -(-least * s // 100), most * s // 100
        self.best = Best(len(rows) * self.width, top, self.low.ravel())

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that any list of an anchor still takes."""
        open_ = self.low <= self.high
        floor = np.where(open_, np.maximum(self.low, self.best.score.reshape(self.low.shape)), ABOVE)
        return floor.min(axis=1), np.where(open_, self.high, -ABOVE).max(axis=1)

    def meet(self, w: dict, dim: int) -> None:
        ids, labels = np.frombuffer(w["ids"], "<i8"), np.frombuffer(w["labels"], "<i8")
        floor, ceiling = self.wanted()
        if self.positives:
            mine = (self.label >= w["label_lo"]) & (self.label <= w["label_hi"])
        else:
            mine = (self.label != w["label_lo"]) | (self.label != w["label_hi"])
        at = np.flatnonzero(mine & (floor <= ceiling))
        low, high = score_bounds(self.norm[at], self.angle[at], (w["norm_lo"], w["norm_hi"]), (np.array(w["angle_lo"]), np.array(w["angle_hi"])))
        at = at[(high >= floor[at]) & (low <= ceiling[at])]
        if not len(at):
            return
        x = np.frombuffer(w["x"], f"<i{w['width']}").reshape(len(ids), dim)
        s = scores(self.x[at], x, self.norm[at].max(), w["norm_hi"])
        # Bounds that a float rounds lie beyond all scores it is used for.
        row, col = np.nonzero((s >= floor[at].astype(s.dtype)[:, None]) & (s <= ceiling[at].astype(s.dtype)[:, None]))
        who = at[row]
        same = self.label[who] == labels[col]
        use = (same == self.positives) & (self.id[who] != ids[col])
        row, col, who = row[use], col[use], who[use]
        score, ids = s[row, col], ids[col]
        for i in range(self.width):
            ok = (score >= self.low[who, i]) & (score <= self.high[who, i])
            self.best.offer(who[ok] * self.width + i, score[ok], ids[ok])

    def found(self) -> pa.RecordBatch:
        which, score, ids = self.best.reduce()
        return pa.RecordBatch.from_arrays([pa.array(self.no[which // self.width]), pa.array((which % self.width).astype(np.int32)), pa.array(score), pa.array(ids)],
                                          ["no", "which", "score", "vec_id"])


def _search(dim: int, refs: np.ndarray, top: int, least: int | None, most: int):
    """A task's anchors come first, then its windows one by one."""
    def run(batches):
        rows, anchors = [], None
        for b in batches:
            for r in b.to_pylist():
                if r["anchor"]:
                    rows.append(r)
                    continue
                anchors = anchors or (_Anchors(rows, dim, refs, top, least, most) if rows else None)
                if anchors is not None:
                    anchors.meet(r, dim)
        if anchors is not None:
            yield anchors.found()
    return run


def _meet(anchors: DataFrame, windows: DataFrame, parts: int, dim: int, refs: np.ndarray, top: int, least: int | None = None, most: int = MOST) -> DataFrame:
    """The best of every list over all slices: no, which, best (array of score, vec_id)."""
    slices = min(SLICES, parts)
    a = anchors.withColumn("block", F.floor(F.col("no") / BLOCK).cast("int"))
    # One row for each BLOCK anchors, three numbers in a row.
    blocks = a.groupBy("block").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    n = int(blocks.agg(F.max("block")).first()[0] or 0) + 1
    meets = ((F.col("label_hi") >= F.col("_lo")) & (F.col("label_lo") <= F.col("_hi")) if least is None
             else (F.col("_lo") != F.col("_hi")) | (F.col("label_lo") != F.col("_lo")) | (F.col("label_hi") != F.col("_lo")))
    w = windows.join(F.broadcast(blocks), meets).drop("_lo", "_hi").withColumn("slice", F.floor(F.col("part") * F.lit(slices) / F.lit(parts)).cast("int"))
    a = a.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    both = a.unionByName(w, allowMissingColumns=True).repartitionById(n * slices, F.col("block") * F.lit(slices) + F.col("slice"))
    both = both.drop("block", "slice", "part", "pos").sortWithinPartitions(F.col("anchor").desc())
    hits = both.mapInArrow(_search(dim, refs, top, least, most), "no long, which int, score long, vec_id long")
    # At most top x SLICES rows of a list.
    ranked = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    best = hits.groupBy("no", "which").agg(F.slice(ranked, 1, top).alias("best"))
    return best.withColumn("best", F.transform("best", lambda e: F.struct((-e["minus"]).alias("score"), e["vec_id"].alias("vec_id"))))


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", every: int = 100, top: int = TOP,
                   least: int = LEAST, most: int = MOST, scale: float = SCALE, references: int = REFERENCES) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, positive_score, rank, negative_id, negative_score.

    Anchors are the rows whose id is divisible by `every`. Positives: the first `top` other rows of the same
    label. Negatives of a positive: the first `top` rows of other labels whose score is from
    least % to most % of the positive's. Scores are inner products of floor(scale * x), higher first, ties by smaller id.

    No part take rows with a NULL id, label or vector, with a NULL or not finite entry, an entry beyond
    `limit` once scaled, or fewer entries than the longest vector. Rows that agree in id, label and vector count
    once; rows that share an anchor's id are never its positives or negatives; an id with several vectors
    or labels is several anchors. A positive without negatives has no row. The reference directions are fitted on
    SAMPLE rows; they decide which windows are scored, never a result. An empty table gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                      F.col(vector).alias("v")).where("vec_id is not null and label is not null and v is not null")
    dim = dimension(src, F.col("v"))
    pick = src.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, SAMPLE_BYTES // (8 * max(dim, 1)))).mapInArrow(_whole(dim, scale, None), "vec_id long, label long, x binary")
    sample = [np.frombuffer(r["x"], "<i4") for r in pick.select("x").collect()]
    refs = _directions(np.array(sample, float).reshape(len(sample), dim), min(references, dim))
    ready = src.mapInArrow(_whole(dim, scale, refs), "vec_id long, label long, x binary, ref int, angle double")
    order = ["label", "ref", "angle", "vec_id", "x"]
    parts = max(1, min(MOST_PARTS, -(-src.count() // PART_ROWS)))
    made = written(ready.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "x").mapInArrow(
        _windows(dim, refs, every, top), _MADE), "angle-windows")
    parts = int(made.agg(F.max("part")).first()[0] or 0) + 1
    windows = made.where("not anchor").drop("vec_id", "label", "seed")
    found = made.where("anchor").select("anchor", "part", "pos", "vec_id", "label", "x", "seed")
    sizes = found.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    anchors = found.join(F.broadcast(before), "part").withColumn("no", F.col("_before") + F.col("pos"))    # at most MOST_PARTS rows
    anchors = written(anchors.drop("_before", "pos", "part"), "anchors")
    best = _meet(anchors, windows, parts, dim, refs, top)
    anchors = written(anchors.join(best.select("no", "best"), "no"), "anchors-with-positives")
    known = anchors.withColumn("scores", F.col("best.score"))
    negatives = _meet(known.drop("best", "seed"), windows, parts, dim, refs, top, least, most)
    rows_of = negatives.select("no", "which", F.posexplode("best").alias("rank", "neg")).join(known.select("no", F.col("vec_id").alias("anchor_id"), F.col("best").alias("pos")), "no")
    pos = F.element_at("pos", F.col("which") + 1)
    return rows_of.select("anchor_id", pos["vec_id"].alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("neg.vec_id").alias("negative_id"),
                          pos["score"].alias("positive_score"), F.col("neg.score").alias("negative_score"))


@query("op11_hard_negatives", sql=f"""
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {TOP})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY rank <= {TOP}""")
def op11_hard_negatives(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(d, label=moved)
