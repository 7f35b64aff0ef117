"""Quality rules: exact base rules and a hashed n-gram log-likelihood ratio.

Byte n-grams of a text are hashed into `BUCKETS`; two multinomials over the
buckets, of the trusted texts and of the raw corpus, give every n-gram the
logarithm of their ratio, and a text the mean over its n-grams. The raw counts
come from every text, the trusted ones from every text labelled as good. The
threshold is the cut in a histogram of the scores of all labelled texts, trusted
ones against bad ones, that makes the fewest errors, counting a lost good text
`COST` times; it is one number for every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import byte_texts, labelled, offsets, segment_sums, slices, small_batches
from echofold.llm.registry import query, table

GRAM = 4
BUCKETS = 1 << 16
#: Added to every bucket of both multinomials.
SMOOTH = 1.0
#: Score bins of the threshold's histogram, over [-SPAN, SPAN].
BINS, SPAN = 4000, 4.0
COST = 20.0
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS = 50
_MULT = np.uint32(0x9E3779B1)


def grams(text: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of each text, flat, and offsets; a text shorter than an n-gram has none."""
    size = np.array([len(t) for t in text], dtype=np.int64)
    flat = np.frombuffer(b"".join(text), dtype=np.uint8).astype(np.uint32)
    n = len(flat) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), offsets(np.zeros(len(text), np.int64))
    code = flat[:n].copy()
    for k in range(1, GRAM):
        code = (code << np.uint32(8)) | flat[k:n + k]
    bucket = ((code * _MULT) >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int64)
    count = np.maximum(size - GRAM + 1, 0)
    end = np.cumsum(size)
    ok = np.ones(len(flat), dtype=bool)
    for k in range(1, GRAM):
        ok[(end - k)[size >= k]] = False
    return bucket[ok[:n]], offsets(count)


def _count(buckets: int):
    """Per task: n-gram counts of all its texts and of its trusted ones."""
    def run(batches):
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            text, y = byte_texts(b, "text"), b.column(1).to_pylist()
            for i, j in slices([len(t) for t in text], 1 << 20):
                g, off = grams(text[i:j], buckets)
                raw += np.bincount(g, minlength=buckets)
                good = np.repeat(np.array([v == 1 for v in y[i:j]], dtype=bool), np.diff(off))
                if good.any():
                    trusted += np.bincount(g[good], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])
    return run


def _mean_ratio(text: list[bytes], ratio: np.ndarray) -> np.ndarray:
    g, off = grams(text, len(ratio))
    return segment_sums(ratio[g], off) / np.maximum(np.diff(off), 1)


def _bins(ratio, kind: str):
    """Per text its id and the bin of its score."""
    def run(batches):
        table_ = ratio.value
        for b in batches:
            text = byte_texts(b, "text")
            at = [np.clip((_mean_ratio(text[i:j], table_) + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)
                  for i, j in slices([len(t) for t in text], 1 << 20)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))], ["doc_id", "bin"])
    return run, f"doc_id {kind}, bin long"


def base_features(text: bytes, ids: dict[bytes, int]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([c])) for c in SPACES)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
        own = np.unique(w, return_inverse=True)[1].astype(np.int64)
        m = int(own.max()) + 1
        pair = np.unique(own[:-1] * m + own[1:], return_inverse=True)[1].astype(np.int64)
        _, inv, count = np.unique(pair[:-1] * m + own[2:], return_inverse=True, return_counts=True)
        hit = count[inv] > 1
        if hit.any():
            cover = np.zeros(n, dtype=bool)
            for k in range(3):
                cover[k:n - 2 + k] |= hit
            repeated = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(ratio, threshold: float):
    def run(batches):
        table_ = ratio.value
        for b in batches:
            text = byte_texts(b, "text")
            rows, ids, score = [], {}, []
            for i, j in slices([len(t) for t in text], 1 << 20):
                score.append(_mean_ratio(text[i:j], table_))
                for t in text[i:j]:
                    rows.append(base_features(t, ids))
                    if len(ids) > 500_000:
                        ids = {}
            f = np.array(rows, dtype=np.int64).reshape(-1, 5)
            s = np.concatenate(score) if score else np.zeros(0)
            failed = (f[:, 0] < MIN_WORDS) | (100 * f[:, 4] > 50 * f[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(f[:, k]) for k in range(5)], pa.array(failed), pa.array(~failed & (s >= threshold)), pa.array(s)],
                ["doc_id", *FEATURES, "base_failed", "kept", "score"])
    return run


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Log ratios of the buckets and the threshold.

    What reaches the driver is bounded by `buckets` and BINS. Texts meet their labels for the
    counts; for the threshold only ids and score bins do. With no labelled texts of both kinds
    the threshold is minus infinity: only the base rules speak.
    """
    small_batches(docs.sparkSession)
    known = labelled(labels, "quality")
    text = docs.select(F.col("doc_id"), F.col("text"))
    # One plan at every size: rows without an id have no label and stay where they are, the rest travels by id.
    marked = text.where("doc_id is not null").join(known.hint("shuffle_hash"), "doc_id", "left").select("text", "y")
    marked = marked.unionByName(text.where("doc_id is null").select("text", F.lit(None).cast("int").alias("y")))
    got = (marked.mapInArrow(_count(buckets), "bucket long, raw long, trusted long").groupBy("bucket")
           .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas())
    raw, trusted = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    raw[got["bucket"].to_numpy(np.int64)] += got["raw"].to_numpy(float)
    trusted[got["bucket"].to_numpy(np.int64)] += got["trusted"].to_numpy(float)
    ratio = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    share = docs.sparkSession.sparkContext.broadcast(ratio)
    scored = text.where("doc_id is not null").mapInArrow(*_bins(share, docs.schema["doc_id"].dataType.simpleString()))
    seen = scored.join(known, "doc_id").groupBy("y", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas()
    h = np.zeros((2, BINS))
    h[seen["y"].to_numpy(np.int64), seen["bin"].to_numpy(np.int64)] = seen["n"].to_numpy(float)
    if not h.sum(axis=1).all():
        return ratio, -np.inf
    # Cut c keeps bins >= c; the middle of the best stretch of cuts stands.
    lost = np.concatenate([[0.0], np.cumsum(h[1])])
    let = h[0].sum() - np.concatenate([[0.0], np.cumsum(h[0])])
    cost = COST * lost / h[1].sum() + let / h[0].sum()
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return ratio, float((best[0] + best[-1]) / 2 * (2 * SPAN / BINS) - SPAN)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, the base features, base_failed, kept and score.

    NULL and empty texts have no words and fail the base rules. Rows are judged
    one by one, so repeated rows and NULL ids come out as they went in.
    """
    ratio, threshold = fit(docs, labels, buckets)
    share = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(
        _judge(share, threshold), f"doc_id {kind}, {', '.join(f'{c} long' for c in FEATURES)}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose texts are kept, all columns, in one pass without exchange."""
    ratio, threshold = fit(docs, labels)
    share = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        table_ = share.value
        for b in batches:
            text, ids, ok = byte_texts(b, "text"), {}, []
            for i, j in slices([len(t) for t in text], 1 << 20):
                for t, s in zip(text[i:j], _mean_ratio(text[i:j], table_), strict=True):
                    n, _, _, _, again = base_features(t, ids)
                    ok.append(n >= MIN_WORDS and 100 * again <= 50 * n and bool(s >= threshold))
                if len(ids) > 500_000:
                    ids = {}
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
