"""Helpers of this subpackage: tables in the shared folder, Arrow batches, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: A class with more than this share of all rows is joined apart; there are fewer than 1 / SHARE of them.
SHARE = 0.001


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by rows and by bytes, so that very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode without a setting, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage is cut there, a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small intermediate tables."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (NULL id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled(labels: DataFrame, label: str, keep: Column | None = None) -> DataFrame:
    """All labelled ids, once each: (doc_id, y). An id with two different labels is left out."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if keep is not None:
        rows = rows.where(keep)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_z")).where("y = _z").drop("_z")


def labelled_sample(labels: DataFrame, label: str, per_class: int, keep: Column | None = None) -> DataFrame:
    """At most `per_class` labelled ids for each of 0 and 1, those with the smallest id hash: (doc_id, y).

    The bound makes it safe to broadcast; which rows are taken depends on ids
    only, not on the layout of the table.
    """
    one = labelled(labels, label, keep)
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    picks = [one.where(F.col("y") == c).orderBy(h, "doc_id").limit(per_class) for c in (0, 1)]
    return picks[0].unionByName(picks[1])


def join_hot(rows: DataFrame, classes: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """Join rows to their classes; classes with more than SHARE of the n rows, fewer than 1 / SHARE of them, are broadcast."""
    hot = F.col(size) > SHARE * n
    heavy = classes.where(hot)
    names = F.broadcast(heavy.select(key))
    light = rows.join(names, key, "left_anti").join(classes.where(~hot), key)
    return light.unionByName(rows.join(F.broadcast(heavy), key))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, NULL as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a batch, NULL as empty."""
    a = batch.column(batch.schema.get_field_index(column))
    return [t or b"" for t in a.cast(pa.large_binary() if pa.types.is_large_string(a.type) else pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of neighbours whose sizes add up to about `most`; a larger one stands alone."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if total and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def offsets(sizes) -> np.ndarray:
    """Start of each piece, and the end of the last."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int64)


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; an empty piece sums to zero."""
    run = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return run[off[1:]] - run[off[:-1]]
