"""WARC archives written in sorted shards, and read back with every digest checked.

Writing. An index (id, digest, size) of the pages is kept; from it come the groups of equal payloads and
the shards: ranges of ids of about `shard_bytes` each, found by adding up sizes over ranges of ids
and halving heavy ranges further, an id with too many bytes by the digest. They depend on
the rows only, not on the layout of the table. Each shard is one task: its rows are
sorted by (id, digest, url) and written as gzip members, a record each; a file that has
reached `roll_bytes` compressed is closed and the next one opened. Headers, record ids and digests are
made anew from the content.

Commit. A task writes under temporary names of its own and reports what it wrote; the
reports that Spark accepted are the list of files. These are renamed, and the manifest
(table `manifest`: name, shard, part, records, bytes, sha1) is written last. A reader knows only files
of the manifest, so lost executors and repeated tasks leave nothing that is read.

Folders are opened with pyarrow's file systems (local, HDFS, S3, GCS), as Spark has no sink for such files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import join_hot, shared_folder, small_batches, written
from echofold.llm.registry import query, table

SHARD_BYTES = 64 << 20
ROLL_BYTES = 8 << 20
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
#: Bytes a record takes besides its payload, about.
RECORD_BYTES = 700
LEVEL = 6
DIGEST_BITS = 48
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, shard int, part int, records long, bytes long, sha1 string"
SAFE = "%/:=&?~#+!$,;'@()*[]<>|^`{}\\\""


# --- shards -----------------------------------------------------------------

def _keyed(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Adds u, the id counted from 1 (NULL is 0), and k, the first bits of the digest."""
    x = F.col("page_id")
    if hi - lo >= 2**62:      # ids over the whole range of a long count in fours
        x, lo = F.shiftright(x, 2), lo >> 2
    k = F.conv(F.substring(F.hex("digest"), 1, DIGEST_BITS // 4), 16, 10).cast("long")
    return df.withColumn("u", F.coalesce(x - F.lit(lo) + 1, F.lit(0))).withColumn("k", k)


def shard_starts(keyed: DataFrame, top: int, shard_bytes: int) -> list[tuple[int, int]]:
    """First (u, k) of each shard but the first, so that a shard holds about shard_bytes, or one id and digest.

    What reaches the driver: at most 64 sums for each 4096th of the ids or shard that is
    still too large.
    """
    su = max(0, top.bit_length() - 12)
    sk, heavy, bins = DIGEST_BITS, None, []
    weight = F.col("n") + RECORD_BYTES
    while True:
        d = keyed
        if heavy is not None:
            pu, pk, rows = heavy
            names = keyed.sparkSession.createDataFrame(rows, "_a long, _b long")
            d = keyed.join(F.broadcast(names), (F.shiftright("u", pu) == F.col("_a")) & (F.shiftright("k", pk) == F.col("_b")), "left_semi")
        got = d.groupBy(F.shiftright("u", su).alias("a"), F.shiftright("k", sk).alias("b")).agg(F.sum(weight).alias("w")).collect()
        last = su == 0 and sk == 0
        over = [(r["a"], r["b"]) for r in got if r["w"] > shard_bytes and not last]
        bins += [(r["a"] << su, r["b"] << sk, r["w"]) for r in got if r["w"] <= shard_bytes or last]
        if not over:
            break
        heavy = (su, sk, over)
        su, sk = (max(0, su - LEVEL), sk) if su else (0, max(0, sk - LEVEL))
    starts, held = [], 0
    for u, k, w in sorted(bins):
        if held and held + w > shard_bytes:
            starts.append((u, k))
            held = 0
        held += w
    return starts


def _shard_of(starts: list[tuple[int, int]]):
    us, ks = np.array([u for u, _ in starts], np.int64), [k for _, k in starts]

    @F.pandas_udf("int")
    def shard(u: pd.Series, k: pd.Series) -> pd.Series:
        lo, hi = np.searchsorted(us, u.to_numpy(), "left"), np.searchsorted(us, u.to_numpy(), "right")
        out = hi.astype(np.int32)
        for at in np.flatnonzero(lo < hi):          # an id that starts shards by its digests
            out[at] = lo[at] + bisect.bisect_right(ks[lo[at]:hi[at]], k.iat[at])
        return pd.Series(out)
    return shard


# --- records ----------------------------------------------------------------

def record_id(page_id: int | None, digest: bytes, copy: int) -> str:
    """The name of a record by its content."""
    seed = hashlib.sha1(f"{page_id}|{digest.hex()}|{copy}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, copy: int, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the record that holds it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date),
              ("WARC-Target-URI", quote(url, safe=SAFE) if url else f"urn:x-page:{page_id}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{_b32(digest)}"), ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).digest())}")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    return _member(fields, block)


class _File:
    """An archive under a temporary name; size and checksum are kept while it is written."""

    def __init__(self, store, folder: str, shard: int, part: int, date: str):
        self.name, self.shard, self.part = f"part-{shard:06d}-{part:04d}.warc.gz", shard, part
        self.temp = f"{folder}/_temporary/{uuid.uuid4().hex}-{self.name}"
        self.out, self.sha, self.bytes, self.records = store.open_output_stream(self.temp, compression=None), hashlib.sha1(), 0, 0
        seed = hashlib.sha1(self.name.encode()).digest()
        self.put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"), ("WARC-Date", date),
                          ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.temp, self.name, self.shard, self.part, self.records, self.bytes, self.sha.hexdigest()


def _store(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _write(folder: str, roll_bytes: int, date: str):
    def run(batches):
        store, root = _store(folder)
        file, done, last, copy, refers = None, [], None, 0, {}
        for b in batches:
            for shard, page_id, digest, revisit, url, payload, to in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if revisit:                         # comes before the page itself
                    refers = {(page_id, digest): to}
                    continue
                copy = copy + 1 if last == (page_id, digest) else 0
                last = (page_id, digest)
                if file is not None and (file.shard != shard or file.bytes >= roll_bytes):
                    done.append(file.close())
                    file = _File(store, root, shard, file.part + 1 if file.shard == shard else 0, date)
                file = file or _File(store, root, shard, 0, date)
                file.put(page_record(page_id, url, payload, digest, copy, refers.get(last), date))
        if file is not None:
            done.append(file.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("temp", "name", "shard", "part", "records", "bytes", "sha1"), r, strict=True)) for r in done], _REPORT)
    return run


_REPORT = pa.schema([("temp", pa.string()), ("name", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def _publish(folder: str):
    """Rename what a report lists; a file that a former run of the task has renamed already is left."""
    def run(batches):
        store, root = _store(folder)
        for b in batches:
            for temp, name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                if store.get_file_info(temp).type == pafs.FileType.File:
                    store.move(temp, f"{root}/{name}")
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name} is not as it was written")
            yield b.select(["name", "shard", "part", "records", "bytes", "sha1"])
    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> None:
    """Archives of `pages` (page_id, url, html) in `folder`, which must not hold a manifest yet.

    Of pages with equal payloads of at least revisit_bytes bytes the one with the largest page_id is a
    response and the others revisit it; rows that share this id are all responses, and a NULL id is smaller than
    any. A NULL html is the empty payload, a NULL url is named after the page, characters that a
    header cannot hold are percent-encoded. Repeated rows get a record each, numbered as copies.
    An empty table gives a manifest without files. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    store, root = _store(folder)
    if store.get_file_info(f"{root}/manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds archives already")
    store.create_dir(f"{root}/_temporary", recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    index = written(src.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "warc-index")
    groups = index.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("last")).where("copies > 1 and last is not null")
    groups = written(groups, "warc-groups")
    lo, hi = (v or 0 for v in index.agg(F.min("page_id"), F.max("page_id")).first())
    starts = shard_starts(_keyed(index, lo, hi), hi - lo + 1, shard_bytes)
    marks = join_hot(index.select("page_id", "digest"), groups, "digest", "copies", index.count()).where("not page_id <=> last").select("page_id", "digest", "last").distinct()
    fields = ["page_id", "digest", "revisit", "url", "payload", "last"]
    every = src.withColumn("revisit", F.lit(False)).withColumn("last", F.lit(None).cast("long")).select(*fields).unionByName(
        marks.withColumn("revisit", F.lit(True)).withColumn("url", F.lit(None).cast("string")).withColumn("payload", F.lit(None).cast("binary")).select(*fields))
    every = _keyed(every, lo, hi).withColumn("shard", _shard_of(starts)("u", "k")) if starts else every.withColumn("shard", F.lit(0))
    every = every.select("shard", *fields).repartitionById(len(starts) + 1, "shard").sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_first(), "digest", F.col("revisit").desc(), F.col("url").asc_nulls_first())
    reports = written(every.mapInArrow(_write(folder, roll_bytes, date), f"temp string, {MANIFEST}"), "warc-reports")
    named = written(reports.repartition(max(1, math.ceil(reports.count() / 100)), "name").mapInArrow(_publish(folder), MANIFEST), "warc-named")
    named.repartition(1).sortWithinPartitions("name").write.parquet(f"{folder}/manifest")
    store.delete_dir(f"{root}/_temporary")


# --- reading ----------------------------------------------------------------

def members(stream, sha=None, chunk: int = 1 << 20):
    """Each gzip member of a stream, whole, with its offset and compressed size."""
    at, z, out, size, rest = 0, zlib.decompressobj(31), [], 0, b""
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                break
            if sha is not None:
                sha.update(rest)
        out.append(z.decompress(rest))
        size += len(rest) - len(z.unused_data)
        rest = z.unused_data
        if z.eof:
            yield at, size, b"".join(out)
            at, z, out, size = at + size, zlib.decompressobj(31), [], 0
    if size:
        raise ValueError("the last member is cut off")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, its block digest checked."""
    cut = member.index(b"\r\n\r\n")
    first, *lines = member[:cut].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = member[cut + 4: cut + 4 + int(fields["Content-Length"])]
    if member[cut + 4 + len(block):] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("record of a wrong length")
    want = fields.get("WARC-Block-Digest")
    if want is not None and want != f"sha1:{_b32(hashlib.sha1(block).digest())}":
        raise ValueError("block digest differs")
    return fields, block


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("refers_to", pa.int64()), ("record_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])


def _page(fields: dict[str, str], block: bytes, file: str, at: int, with_payload: bool) -> dict:
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:] if line)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind, payload = fields["WARC-Type"], block[cut:]
    if kind == "response" and (len(payload) != int(http["Content-Length"]) or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {"page_id": page and int(page), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": int(http["Content-Length"]), "payload_digest": digest.hex(),
            "refers_to": to and int(to), "record_id": fields["WARC-Record-ID"], "file": file, "offset": at,
            "payload": payload if with_payload and kind == "response" else None}


def _read(folder: str, with_payload: bool):
    def run(batches):
        store, root = _store(folder)
        for b in batches:
            for name, records, size, want in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                sha, rows, held, n = hashlib.sha1(), [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for at, _, member in members(stream, sha):
                        fields, block = parse(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_page(fields, block, name, at, with_payload))
                        n, held = n + 1, held + (len(block) if with_payload else 300)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows, held = [], 0
                if n != records or sha.hexdigest() != want or store.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} is not as the manifest says")
                yield pa.RecordBatch.from_pylist(rows, _ROW)
    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's files: page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, file, offset, payload.

    payload is NULL unless asked for, and of revisits. A file or record that differs from its checksum
    or the manifest fails the job; files that are not in the manifest are not read.
    """
    small_batches(spark)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name", "records", "bytes", "sha1")
    kinds = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, file string, offset long, payload binary"
    return files.repartition(max(1, files.count()), "name").mapInArrow(_read(folder, with_payload), kinds)


@query("op12_warc", sql=f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM p LEFT JOIN g USING (payload_digest)""")
def op12_warc(spark, sf_dir):
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
