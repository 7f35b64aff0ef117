"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its distinct words and their stems, a document's the noisy-or of its sentences:
1 - prod(1 - p). Only documents carry labels; the gradient of their likelihood
flows back through the noisy-or to the sentences, and so to the words, which
afterwards point to the sentences at fault.

Fitted on a bounded sample of labelled documents, every text is scored whole.
Words are looked up by hash; a word outside the model has weight zero. So a
sentence without a word of the model has the base probability, which is near zero,
and a document's score is worked out from its other sentences and their number.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import crc_mod, labelled_sample, offsets, segment_sums, slices, small_batches, texts, written
from echofold.llm.near_dups import WordHashes
from echofold.llm.registry import query, table

#: Labelled documents of each class that are fitted on; words kept at most, in how many documents and with what log odds at least.
SAMPLE = 2_500
WORDS_MOST, WORDS_LEAST, ODDS_LEAST = 50_000, 5, 1.0
ROUNDS, RATE, RIDGE = 300, 0.2, 5e-5
#: Prior of the bias: log odds of a sentence none of whose words the model knows.
BIAS = -9.0
#: A sentence is marked as toxic from this probability on.
SENTENCE = 0.5
#: Lengths of the beginnings of words that are features beside the word.
STEMS = (4, 5)
MEMO = 500_000
_END = re.compile(r"[.!?]+\s+|\n+")
_EDGE = b".,;:!?\"'()[]{}|*#$%&<>-_/\\"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold anything but white space."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at:m.end()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def words(sentence: str) -> list[bytes]:
    """Lower-cased words without marks at their edges."""
    return [w for w in (x.strip(_EDGE) for x in sentence.lower().encode("utf-8", "replace").split()) if w]


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings of `STEMS` characters, for languages that inflect; always as many, empty where too short."""
    text = word.decode("utf-8", "replace")
    return [word, *[b"\0" + text[:n].encode("utf-8", "replace") if len(text) > n else b"" for n in STEMS]]


@lru_cache(maxsize=1)
def hashes() -> WordHashes:
    return WordHashes()


def _support(batches):
    """How many toxic and how many clean documents of a batch hold each feature."""
    look = hashes()
    for b in batches:
        y, text = b.column(0).to_pylist(), texts(b)
        for i, j in slices([len(t) for t in text], 2_000_000):
            count = [Counter(), Counter()]
            for v, t in zip(y[i:j], text[i:j], strict=True):
                count[v].update({f for x, z in sentence_spans(t) for w in words(t[x:z]) for f in features(w)})
            every = sorted(count[0].keys() | count[1].keys())
            if every:
                yield pa.RecordBatch.from_arrays([pa.array(look([every]).astype(np.int64)), pa.array([count[1][f] for f in every], pa.int64()),
                                                  pa.array([count[0][f] for f in every], pa.int64())], ["f", "n1", "n0"])


def _bags(vocab):
    """Per document its sentences' sizes and the places of their features in the vocabulary."""
    def run(batches):
        look, kept = hashes(), vocab.value
        for b in batches:
            y, text = b.column(0).to_pylist(), texts(b)
            for i, j in slices([len(t) for t in text], 2_000_000):
                sizes, places = [], []
                for t in text[i:j]:
                    bags = [[f for w in sorted(set(words(t[x:z]))) for f in features(w)] for x, z in sentence_spans(t)]
                    h = look(bags).astype(np.int64) if bags else np.zeros(0, np.int64)
                    at = np.minimum(np.searchsorted(kept, h), max(len(kept) - 1, 0))
                    hit = kept[at] == h if len(kept) else np.zeros(len(h), dtype=bool)
                    sizes.append(segment_sums(hit.astype(np.int64), offsets([len(s) for s in bags])).tolist())
                    places.append(at[hit].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(y[i:j], pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(places, pa.binary())],
                                                 ["y", "sizes", "places"])
    return run


def noisy_or(logit: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log of the probability that no sentence of a document is toxic."""
    return segment_sums(-np.logaddexp(0.0, logit), off)


def fit(rows: list[tuple[int, list[int], bytes]], kept: np.ndarray) -> tuple[dict[int, float], float]:
    """Weights of features by hash, and the bias, from (label, sentence sizes, places in `kept`).

    Gradient steps with momentum scaling (Adam) over all documents at once, classes weighted
    by their number. With one class only, no word has a weight and no sentence is toxic.
    """
    if len({r[0] for r in rows}) < 2:
        return {}, -12.0
    y = np.array([r[0] for r in rows], dtype=float)
    size = np.concatenate([np.asarray(r[1], dtype=np.int32) for r in rows])
    of_doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
    col = np.concatenate([np.frombuffer(r[2], dtype=np.int32) for r in rows])
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    sentence_off, doc_off = len(size), offsets([len(r[1]) for r in rows])
    w, b = np.zeros(len(kept)), BIAS
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for t in range(1, ROUNDS + 1):
        logit = b + np.bincount(row, weights=w[col], minlength=sentence_off)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        none = np.minimum(noisy_or(logit, doc_off), -1e-9)
        # d log P(y) / d logit: -p for a clean document, p * P(none) / P(some) for a toxic one.
        up = np.where(y == 1, np.exp(none) / -np.expm1(none), -1.0) * weight
        g_s = up[of_doc] * p
        g = np.bincount(col, weights=g_s[row], minlength=len(kept)) - RIDGE * w
        gb = g_s.sum() - 40 * RIDGE * (b - BIAS)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b += RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    strong = np.abs(w) > 1e-3
    return dict(zip(kept[strong].tolist(), w[strong].tolist(), strict=True)), float(b)


class Scorer:
    """Scores of documents and of their sentences."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.keys = np.array(sorted(weights), dtype=np.int64)
        self.w = np.array([weights[k] for k in self.keys.tolist()], dtype=float)
        self.bias, self.memo = bias, {}

    def _weights(self, new: list[bytes]) -> None:
        h = hashes()([[f for x in new for f in features(x)]]).astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        w = np.where(self.keys[at] == h, self.w[at], 0.0) if len(self.keys) else np.zeros(len(h))
        w = w.reshape(len(new), -1).sum(axis=1)
        self.memo.update(zip(new, w.tolist(), strict=True))

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and the sentences that are toxic by themselves, with their probabilities."""
        spans = sentence_spans(text)
        ws = [set(words(text[x:z])) for x, z in spans]
        every = set().union(*ws)
        new = every.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, every
        if new:
            self._weights(list(new))
        look = self.memo.__getitem__
        logit = np.array([self.bias + sum(sorted(map(look, s))) for s in ws])
        none = float(-np.logaddexp(0.0, logit).sum()) if len(logit) else 0.0
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return float(-np.expm1(none)), [(x, z, float(q)) for (x, z), q in zip(spans, p, strict=True) if q >= SENTENCE]


def _score(model):
    def run(batches):
        score = Scorer(*model.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            got = [score(t) for t in texts(b)]
            spans = [[{"start": x, "end": z, "score": p} for x, z, p in s] for _, s in got]
            s = np.clip([g[0] for g in got], 0.0, 1.0) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                                             ["doc_id", "held_out", "score", "predicted", "sentences"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: (doc_id, held_out, score, predicted, sentences): sentences at fault as (start, end, score) in code points.

    A NULL or empty text has no sentence and score 0. Labels are learnt only from
    rows that are not held out, at most `sample` of each class. Without labels of
    both classes nothing is toxic. Rows are scored one by one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id"), F.col("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = F.broadcast(labelled_sample(labels, "toxic", sample, crc_mod(F.col("doc_id"), 5) != 0))
    some = written(docs.join(known, "doc_id").select("y", "text"), "toxic-sample")
    total = {int(r["y"]): r["count"] for r in some.groupBy("y").count().collect()}
    support = some.mapInArrow(_support, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.abs(F.log((F.col("n1") + 1) / (total.get(1, 0) + 2)) - F.log((F.col("n0") + 1) / (total.get(0, 0) + 2)))
    telling = support.withColumn("odds", odds).where((F.col("n1") + F.col("n0") >= WORDS_LEAST) & (F.col("odds") >= ODDS_LEAST))
    kept = np.array(sorted(r[0] for r in telling.orderBy(F.desc("odds"), "f").limit(WORDS_MOST).select("f").collect()), dtype=np.int64)
    got = some.mapInArrow(_bags(spark.sparkContext.broadcast(kept)), "y int, sizes array<int>, places binary").toPandas()
    rows = sorted((int(y), [int(n) for n in s], bytes(w)) for y, s, w in zip(got["y"], got["sizes"], got["places"], strict=True))
    model = spark.sparkContext.broadcast(fit(rows, kept))
    return docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text").mapInArrow(
        _score(model), f"doc_id {kind}, held_out boolean, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
