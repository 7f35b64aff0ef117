"""Token-ID files: range asymmetric numeral systems with one static table.

A document's ids are cut into blocks of `BLOCK` ids; a block has up to `LANES`
coder states, and id i belongs to lane i mod lanes (interleaved). Every block
stands alone: its record holds the end states (the checkpoints from which decoding starts),
the number of words of each lane and a crc32 of its ids, so blocks decode in any
order and in parallel. All share one frequency table, counted over all ids of
the corpus and scaled to 2**SCALE. Many blocks are coded in lockstep, one numpy step
for an id of every lane.

Record of a document, little-endian: u32 ids, u32 blocks; per block u32 crc32,
u8 lanes, lanes x u64 states, lanes x u16 word counts; then the 32-bit words of
all lanes in that order.

Files: folder `table` (id, freq), folder `blocks` by range of doc_id (bucket),
in each file rows in ascending doc_id: doc_id, first (ids of the bucket before
the document), n_tokens, record.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.llm.common import offsets, shared_folder, slices, small_batches, written
from echofold.llm.encode import encoder
from echofold.llm.registry import query, table

SCALE = 20
BLOCK = 2048
LANES = 4
LANE_MIN = 96
LOW = np.uint64(1 << 31)
#: Ids of one bucket, about, and the most buckets.
BUCKET = 1 << 23
MOST_BUCKETS = 20_000
CHARS = 2_000_000


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of ids that occur, at least 1 each, that add up to 2**scale."""
    total = 1 << scale
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.int64)
    if seen.sum() > total:
        raise ValueError("more ids than the table has places")
    freq = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
    # What rounding left over or took too much goes to the most frequent ids.
    order = np.argsort(-counts, kind="stable")
    short = total - int(freq.sum())
    if short > 0:
        freq[order[0]] += short
    while short < 0:
        for i in order:
            if short == 0 or freq[i] <= 1:
                break
            cut = min(-short, max(1, int(freq[i]) // 16))
            freq[i] -= cut
            short += cut
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = np.uint64(scale), freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(63 - scale)

    @staticmethod
    def _lay_out(sizes: np.ndarray):
        """Blocks and lanes of documents of these sizes, lanes sorted by falling length."""
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(sizes[doc] - nth * BLOCK, BLOCK)
        return blocks, length, np.clip(length // LANE_MIN, 1, LANES)

    @staticmethod
    def _cells(length, lanes):
        """For every id its step and its lane's place; for every lane its length; the order of lanes."""
        base = np.cumsum(lanes) - lanes
        block = np.repeat(np.arange(len(length)), length)
        i = np.arange(len(block)) - np.repeat(np.cumsum(length) - length, length)
        lane, step = base[block] + i % lanes[block], i // lanes[block]
        steps = np.bincount(lane, minlength=int(lanes.sum())).astype(np.int64)
        order = np.argsort(-steps, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return place[lane], step, steps, order, place

    def encode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """One record for each document."""
        blocks, length, lanes = self._lay_out(sizes)
        place, step, steps, order, where = self._cells(length, lanes)
        n, most = len(steps), int(steps.max()) if len(steps) else 0
        grid = np.zeros((most, n), dtype=np.uint32)
        grid[step, place] = flat
        active = n - np.searchsorted(steps[order][::-1], np.arange(most), side="right")
        state = np.full(n, LOW, dtype=np.uint64)
        words, out = np.zeros((most, n), dtype=np.uint32), np.zeros((most, n), dtype=bool)
        for t in range(most - 1, -1, -1):
            k = int(active[t])
            s, x = grid[t, :k], state[:k]
            f = self.freq[s]
            full = x >= self.limit[s]
            words[t, :k], out[t, :k] = x.astype(np.uint32), full
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[:k] = (q << self.scale) + (x - q * f) + self.cum[s]
        count = out.sum(axis=0)[where]
        stream = np.ascontiguousarray(words.T)[where][np.ascontiguousarray(out.T)[where]]
        state = state[where]
        raw, ids = stream.tobytes(), flat.astype("<u4").tobytes()
        lane_at, word_at = offsets(lanes).tolist(), (offsets(count) * 4).tolist()
        id_at = (offsets(length) * 4).tolist()
        state_b, count_b = state.astype("<u8").tobytes(), count.astype("<u2").tobytes()
        records, b = [], 0
        for size, many in zip(sizes.tolist(), blocks.tolist(), strict=True):
            head, body = [struct.pack("<II", size, many)], []
            for i in range(b, b + many):
                x, y = lane_at[i], lane_at[i + 1]
                head += [struct.pack("<IB", zlib.crc32(ids[id_at[i]:id_at[i + 1]]), y - x), state_b[8 * x:8 * y], count_b[2 * x:2 * y]]
                body.append(raw[word_at[x]:word_at[y]])
            records.append(b"".join(head + body))
            b += many
        return records

    def decode(self, records: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all records, flat, and the size of each; a checksum that differs is an error."""
        sizes, crcs, lanes, states, counts, bodies = [], [], [], [], [], []
        for r in records:
            size, many = struct.unpack_from("<II", r, 0)
            at = 8
            for _ in range(many):
                crc, k = struct.unpack_from("<IB", r, at)
                crcs.append(crc)
                lanes.append(k)
                states.append(r[at + 5:at + 5 + 8 * k])
                counts.append(r[at + 5 + 8 * k:at + 5 + 10 * k])
                at += 5 + 10 * k
            sizes.append(size)
            bodies.append(r[at:])
        sizes = np.array(sizes, dtype=np.int64)
        _, length, expected = self._lay_out(sizes)
        lanes = np.array(lanes, dtype=np.int64)
        if len(lanes) != len(expected) or (lanes != expected).any():
            raise ValueError("a record's blocks do not fit its size")
        place, step, steps, order, where = self._cells(length, lanes)
        n, most = len(steps), int(steps.max()) if len(steps) else 0
        state = np.frombuffer(b"".join(states), dtype="<u8")[order].astype(np.uint64)
        count = np.frombuffer(b"".join(counts), dtype="<u2").astype(np.int64)
        words = np.append(np.frombuffer(b"".join(bodies), dtype="<u4").astype(np.uint64), np.uint64(0))
        at = (np.cumsum(count) - count)[order]
        active = n - np.searchsorted(steps[order][::-1], np.arange(most), side="right")
        grid = np.zeros((most, n), dtype=np.uint32)
        mask = np.uint64((1 << int(self.scale)) - 1)
        for t in range(most):
            k = int(active[t])
            x = state[:k]
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            grid[t, :k] = s
            x = self.freq[s] * (x >> self.scale) + slot - self.cum[s]
            short = x < LOW
            state[:k] = np.where(short, (x << np.uint64(32)) | words[np.minimum(at[:k], len(words) - 1)], x)
            at[:k] += short
        flat = grid[step, place]
        raw, cut = flat.astype("<u4").tobytes(), (offsets(length) * 4).tolist()
        for crc, x, y in zip(crcs, cut[:-1], cut[1:], strict=True):
            if zlib.crc32(raw[x:y]) != crc:
                raise ValueError("checksum of a block differs")
        return flat, sizes


def _shards(vocabulary: str, end_id: int):
    """Ids of a few texts as one row, low and high bytes apart, which compresses better; after them a row of how often the task saw each id."""
    def run(batches):
        enc, total, ids = encoder(vocabulary), np.zeros(end_id + 1, np.int64), pa.null()
        for b in batches:
            names, text, ids = b.column(0).to_pylist(), b.column(1), b.schema.field(0).type
            every, off = enc.column(text)       # of the whole batch, which handles a piece of several slices once
            every, off = np.insert(every, off[1:], end_id), off + np.arange(len(off))
            for i, j in slices(pc.fill_null(pc.utf8_length(text), 0).to_pylist(), CHARS):
                flat = every[off[i]:off[j]]
                planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, enc.kind.itemsize).T)
                n = np.bincount(flat, minlength=len(total))
                n[:len(total)] += total
                total = n
                yield row(ids, names[i:j], np.diff(off[i:j + 1]), planes.tobytes(), enc.kind.itemsize, None)
        if total.any():
            at = np.flatnonzero(total)
            yield row(ids, [], np.zeros(0, np.int64), b"", enc.kind.itemsize, np.stack([at, total[at]]).astype("<i8").tobytes())

    def row(ids, names, sizes, planes, width, seen):
        return pa.RecordBatch.from_arrays(
            [pa.array([names], pa.list_(ids)), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes, pa.int64())), pa.array([planes], pa.binary()), pa.array([width], pa.int32()), pa.array([seen], pa.binary())],
            ["doc_ids", "sizes", "planes", "width", "seen"])
    return run


def _rows(batch) -> list[tuple[list, np.ndarray, np.ndarray]]:
    out = []
    for names, sizes, planes, width in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
        flat = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()
        out.append((names, np.array(sizes, dtype=np.int64), flat))
    return out


def _counts(batches):
    """The counts of several tasks added up."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for seen in b.column(0).to_pylist():
            at, n = np.frombuffer(seen, "<i8").reshape(2, -1)
            total = np.pad(total, (0, max(0, int(at.max()) + 1 - len(total))))
            total[at] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def _encode(freq, cuts):
    def run(batches):
        coder, bounds = Coder(freq.value), np.array(cuts.value)
        for b in batches:
            for names, sizes, flat in _rows(b):
                records = coder.encode(flat, sizes)
                bucket = [0 if x is None else int(np.searchsorted(bounds, x, side="left")) for x in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), pa.array(names, b.schema.field(0).type.value_type), pa.array(sizes), pa.array(records, pa.binary())],
                    ["bucket", "doc_id", "n_tokens", "record"])
    return run


def _number(batches):
    """Ids of the bucket before each document; rows come in order of bucket and document."""
    bucket, run = None, 0
    for b in batches:
        first = []
        for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != bucket:
                bucket, run = k, 0
            first.append(run)
            run += n
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(first, pa.int64()), b.column(2), b.column(3)],
                                         ["bucket", "doc_id", "first", "n_tokens", "record"])


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode every text and its end id into the files under `folder`, in ascending doc_id.

    NULL ids come first; rows of one id are ordered by their number of ids and
    their record. An empty table gives files without rows. What reaches the
    driver: the table (one row per vocabulary entry) and the bounds of the buckets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = written(docs.select(F.col("doc_id"), F.col("text")).mapInArrow(
        _shards(vocabulary, end_id), f"doc_ids array<{kind}>, sizes array<bigint>, planes binary, width int, seen binary"), "shards")
    seen = shards.where("seen is not null").select("seen").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(seen["id"].max()) + 1 if len(seen) else 1, dtype=np.int64)
    counts[seen["id"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    freq = scaled(counts)
    at = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in at], "id int, freq int").coalesce(1).write.parquet(f"{folder}/table")
    n = min(MOST_BUCKETS, max(1, round(int(counts.sum()) / BUCKET)))
    cuts = []
    if n > 1:
        got = shards.select(F.explode("doc_ids").alias("doc_id")).agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] or []
        cuts = sorted(set(got))
    sc = spark.sparkContext
    made = shards.where("seen is null").drop("seen").mapInArrow(_encode(sc.broadcast(freq), sc.broadcast(cuts)), f"bucket int, doc_id {kind}, n_tokens long, record binary")
    made = made.repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n_tokens", "record")
    made = made.mapInArrow(_number, f"bucket int, doc_id {kind}, first long, n_tokens long, record binary")
    made.write.option("compression", "uncompressed").partitionBy("bucket").parquet(f"{folder}/blocks")


def _decode(freq, with_ids: bool):
    def run(batches):
        coder = Coder(freq.value)
        for b in batches:
            records = b.column(3).to_pylist()
            for i, j in slices([len(r) for r in records], 1 << 20):
                flat, sizes = coder.decode(records[i:j])
                raw, cut = flat.astype("<u4").tobytes(), (offsets(sizes) * 4).tolist()
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                cols = [b.column(0)[i:j], b.column(1)[i:j], b.column(2)[i:j], pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["bucket", "doc_id", "first", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and ids), decoded from the files and checked."""
    small_batches(spark)
    rows = spark.read.parquet(f"{folder}/table").toPandas()
    freq = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    freq[rows["id"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.int64)
    kind = None
    try:
        blocks = spark.read.parquet(f"{folder}/blocks")
        kind = blocks.schema["doc_id"].dataType.simpleString()
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    size = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("_n"))
    before = size.select("bucket", F.coalesce(F.sum("_n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    got = blocks.select(F.col("bucket").cast("int").alias("bucket"), "doc_id", "first", "record").mapInArrow(
        _decode(spark.sparkContext.broadcast(freq), with_ids),
        f"bucket int, doc_id {kind}, first long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    got = got.join(F.broadcast(before), "bucket")  # at most MOST_BUCKETS rows
    return got.select("doc_id", (F.col("first") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)
