"""Language of whole texts by a blended-spectrum string kernel.

For each length n in `GRAMS` a text is the set (presence, not counts) of its
letter n-grams, hashed into `DIM` places; the kernel of two texts is the mean over
n of |A and B| / sqrt(|A| |B|). Landmarks Z are a part of a bounded training
sample (Nystroem): with K the kernel among landmarks and C that of the sample
against them, one-versus-rest ridge regression solves
(C'C + lambda K) a = C'y for each language, and a text x scores k(x, Z) a.
Since k(x, z) is a product of presence vectors, k(x, Z) a is one matrix product
of a batch's presence bits with Z'a, per length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import crc_mod, slices, small_batches, texts
from echofold.llm.registry import query, table

GRAMS = (1, 2, 3, 4)
DIM = 1 << 13
#: Training texts of each language, and how many of them are landmarks.
SAMPLE, LANDMARKS = 400, 100
#: Languages told apart at most: the bound of the model.
LANGUAGES = 200
RIDGE = 1e-2
#: Sharpness of the softmax that turns regression outputs into a score.
SHARP = 8.0
_MULT = np.uint64(0x9E3779B97F4A7C15)


def presence(batch: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Presence of hashed n-grams, bool (texts, lengths, dim), and whether a text has a letter.

    Letters count in lower case, everything between them as one space.
    """
    out = np.zeros((len(batch), len(GRAMS), dim), dtype=bool)
    letters = np.zeros(len(batch), dtype=bool)
    for row, text in enumerate(batch):
        code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        if not len(code):
            continue
        alpha = is_letter(code)
        if not alpha.any():
            continue
        letters[row] = True
        code = np.where(alpha, code, np.uint32(32)).astype(np.uint64)
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = alpha[1:] | alpha[:-1]
        code = np.concatenate([[np.uint64(32)], code[keep], [np.uint64(32)]])
        h = np.zeros(len(code), dtype=np.uint64)
        for k, n in enumerate(GRAMS):
            if len(code) < n:
                break
            h = (h[:len(code) - n + 1] + code[n - 1:]) * _MULT  # one more character at the end
            out[row, k, (h >> np.uint64(64 - dim.bit_length() + 1)).astype(np.int64)] = True
    return out, letters


_LETTER = np.zeros(0x110000, dtype=bool)


def is_letter(code: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, from a table made once in a process."""
    if not _LETTER[97]:
        _LETTER[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER[code]


def _packed(batches):
    for b in batches:
        langs = b.column(0).to_pylist()
        text = texts(b)
        for i, j in slices([len(t) for t in text], 500_000):
            bits, letters = presence(text[i:j])
            rows = [np.packbits(x).tobytes() for x in bits]
            yield pa.RecordBatch.from_arrays([pa.array([v if ok else None for v, ok in zip(langs[i:j], letters, strict=True)], pa.string()), pa.array(rows, pa.binary())], ["lang", "bits"])


def normalised(bits: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that their products are the kernel."""
    size = np.maximum(bits.sum(axis=2, keepdims=True), 1)
    return (bits / np.sqrt(size * len(GRAMS))).astype(np.float32)


def fit(rows: list[tuple[str, bytes]]) -> tuple[list[str], np.ndarray]:
    """Languages and the weights (lengths, dim, languages) from (lang, packed bits), in a fixed order of rows."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], np.zeros((len(GRAMS), DIM, 0), np.float32)
    x = np.stack([np.unpackbits(np.frombuffer(r[1], dtype=np.uint8)).reshape(len(GRAMS), DIM) for r in rows]).astype(bool)
    x = normalised(x).reshape(len(rows), -1)
    y = np.array([langs.index(r[0]) for r in rows])
    mark = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS] for k in range(len(langs))])
    z = x[mark]
    c = (x @ z.T).astype(np.float64)
    k = c[mark]
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y)[y]
    a = np.linalg.solve(c.T @ (c * weight[:, None]) + RIDGE * k + 1e-8 * np.eye(len(mark)), c.T @ (target * weight[:, None]))
    return langs, (z.T @ a).astype(np.float32).reshape(len(GRAMS), DIM, -1)


def _predict(model, none: str):
    def run(batches):
        langs, w = model.value
        for b in batches:
            text, pred, score = texts(b), [], []
            for i, j in slices([min(len(t), 100_000) + 2_000 for t in text], 500_000):
                bits, letters = presence(text[i:j])
                out = np.zeros((j - i, len(langs)), np.float32)
                for k in range(len(GRAMS)):
                    size = np.maximum(np.count_nonzero(bits[:, k], axis=1), 1)
                    out += bits[:, k].astype(np.float32) @ w[k] / np.sqrt(size * len(GRAMS), dtype=np.float32)[:, None]
                if langs:
                    e = np.exp(SHARP * (out - out.max(axis=1, keepdims=True)).astype(np.float64))
                    p = e / e.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    pred += [langs[k] if ok else none for k, ok in zip(best, letters, strict=True)]
                    score += np.where(letters, p[np.arange(len(p)), best], 0.0).tolist()
                else:
                    pred += [none] * (j - i)
                    score += [0.0] * (j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, sample: int = SAMPLE, none: str = "und") -> DataFrame:
    """Per row: (doc_id, held_out, lang_pred, score).

    Fitted on at most `sample` texts of each language among rows that are not held out: those
    with the smallest hash of (id, text). A NULL text and one without a letter are `und`, score 0;
    so is everything if no row has a label. Only presence bits of the sample reach the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.where("lang is not null and text is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
    names = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    # A key that places a text in the sample: first the share that can be in it, then the exact order of the few.
    h = F.xxhash64("doc_id", F.length("text"), F.lit(23))
    picked = None
    for name in sorted(names):
        one = known.where(F.col("lang") == name).select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(sample)
        picked = one if picked is None else picked.unionByName(one)
    rows = []
    if picked is not None:
        ids = F.broadcast(picked.distinct())  # at most LANGUAGES * sample rows
        some = known.withColumn("h", h).join(ids, ["doc_id", "h"], "left_semi")
        got = some.select("lang", "text").mapInArrow(_packed, "lang string, bits binary").where("lang is not null").toPandas()
        rows = sorted(zip(got["lang"], got["bits"].map(bytes), strict=True))
        # Which of a language's texts are landmarks must not depend on their content's order.
        order = np.random.default_rng(0).permutation(len(rows))
        rows = [rows[i] for i in order]
    model = spark.sparkContext.broadcast(fit(rows))
    return docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInArrow(
        _predict(model, none), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
