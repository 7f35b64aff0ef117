"""Archives against a plain reading of their bytes; shards, copies, commit and damage."""

import base64
import gzip
import hashlib
import os
import random
import re

import pytest

from echofold.llm import warc


def frame(spark, rows, parts=3):
    full = [(i, u, h, "x", 1, b"p", 2) for i, u, h in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, digest string, shard int, payload binary, u int").repartition(parts)


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abcdefgh \n<>é") for _ in range(n))


def plain(folder):
    """Records of every archive by a reading of its own: (file, type, page, digest, length of the payload, refers to)."""
    out = []
    for f in sorted(os.listdir(folder)):
        if not f.endswith(".warc.gz"):
            continue
        raw = gzip.open(f"{folder}/{f}").read()
        while raw:
            cut = raw.index(b"\r\n\r\n") + 4
            h = dict(re.findall(r"([^:\r\n]+): ([^\r\n]*)", raw[:cut].decode()))
            n = int(h["Content-Length"])
            body, raw = raw[cut:cut + n], raw[cut + n + 4:]
            if h["WARC-Type"] == "warcinfo":
                continue
            payload = body.split(b"\r\n\r\n", 1)[1]
            if h["WARC-Type"] == "response":
                assert h["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.append((f, h["WARC-Type"], h.get("X-Page-Id"), h["WARC-Payload-Digest"], len(payload), h.get("X-Refers-To-Page-Id"), h["WARC-Record-ID"], h.get("WARC-Refers-To")))
    return out


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    key = lambda i: (i is not None, i or 0)
    last = {}
    for i, _, h in rows:
        last.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw, ids = (h or "").encode(), last[h or ""]
        top = max(ids, key=key)
        again = len(raw) >= 1000 and top is not None and i != top
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def columns(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)


@pytest.fixture
def mixed():
    rows = [(i, f"http://a.example/{i}", text(i, 300 + 37 * (i % 60))) for i in range(400)]
    rows += [(1000 + i, "http://copy.example/ü x\r\ny", text(7, 5000)) for i in range(150)]             # copies over many ids
    rows += [(2000 + i, None, text(8, 999)) for i in range(5)] + [(2100 + i, "u", text(9, 1000)) for i in range(5)]
    rows += [(5, "http://a.example/5", text(5, 300 + 37 * 5))] * 3 + [(3000, "z", text(11, 2000))] * 2     # repeated rows
    rows += [(None, "n", text(10, 3000)), (None, "n2", text(7, 5000)), (None, None, None), (3001, "e", None), (3002, "e", ""), (-4, "neg", "x" * 200_000), (2**62, "far", "f" * 1500)]
    return rows


def test_round_trip_and_layout(spark, tmp_path, mixed):
    folders = [f"{tmp_path}/{k}" for k in "ab"]
    for folder, parts in zip(folders, (2, 7), strict=True):
        warc.write_warc(frame(spark, mixed, parts), folder, shard_bytes=100_000, roll_bytes=20_000)
    got = warc.read_warc(spark, folders[0], with_payload=True)
    assert columns(got) == brute(mixed)
    texts = {(r.page_id, r.payload_digest): r.payload.decode() for r in got.where("record_type = 'response'").collect()}
    assert all(texts[i, hashlib.sha1((h or "").encode()).hexdigest()] == (h or "") for i, _, h in mixed if (i, hashlib.sha1((h or "").encode()).hexdigest()) in texts)
    # The same bytes whatever the layout of the table.
    a, b = ({f: open(f"{d}/{f}", "rb").read() for f in os.listdir(d) if f.endswith(".gz")} for d in folders)
    assert a == b and len(a) > 10
    # A plain reading agrees, ids rise over the files, record ids are unique, revisits name a record that is there.
    rec = plain(folders[0])
    assert len(rec) == len(mixed)
    order = [int(r[2]) if r[2] is not None else -10**30 for r in rec]
    assert order == sorted(order)
    names = [r[6] for r in rec]
    assert len(set(names)) == len(names) and {r[7] for r in rec if r[7]} <= {r[6] for r in rec if r[1] == "response"}
    assert all(r[4] == 0 for r in rec if r[1] == "revisit")
    m = spark.read.parquet(f"{folders[0]}/manifest").collect()
    assert sorted(r["name"] for r in m) == sorted(a) and all(r["bytes"] == len(a[r["name"]]) for r in m)
    assert max(r["part"] for r in m) > 0 and not os.path.exists(f"{folders[0]}/_temporary")


def test_one_id_with_too_many_bytes_is_cut_by_digest(spark, tmp_path):
    rows = [(3, "u", text(i, 4000)) for i in range(60)] + [(i, "v", text(100 + i, 100)) for i in range(6)]
    warc.write_warc(frame(spark, rows), str(tmp_path / "w"), shard_bytes=40_000)
    m = spark.read.parquet(f"{tmp_path}/w/manifest").toPandas()
    assert m.shard.nunique() >= 6 and m.records.max() <= 15
    assert columns(warc.read_warc(spark, str(tmp_path / "w"))) == brute(rows)


def test_only_files_of_the_manifest_are_read_and_damage_is_seen(spark, tmp_path):
    d = str(tmp_path / "w")
    rows = [(i, "u", text(i, 500)) for i in range(20)]
    warc.write_warc(frame(spark, rows), d)
    with open(f"{d}/part-000000-0000.warc.gz", "rb") as f:
        raw = f.read()
    with open(f"{d}/part-000009-0000.warc.gz", "wb") as f:      # left by a task that was lost
        f.write(raw)
    assert columns(warc.read_warc(spark, d)) == brute(rows)
    with pytest.raises(FileExistsError):
        warc.write_warc(frame(spark, rows), d)
    with open(f"{d}/part-000000-0000.warc.gz", "wb") as f:
        f.write(raw[:-40] + bytes([raw[-40] ^ 1]) + raw[-39:])
    with pytest.raises(Exception, match="differ|manifest|incorrect|invalid|cut off"):
        warc.read_warc(spark, d).collect()


def test_publishing_twice_changes_nothing(spark, tmp_path):
    import pyarrow as pa
    d = str(tmp_path / "w")
    os.makedirs(f"{d}/_temporary")
    with open(f"{d}/_temporary/t", "wb") as f:
        f.write(b"abc")
    b = pa.RecordBatch.from_pylist([{"temp": f"{d}/_temporary/t", "name": "n", "shard": 0, "part": 0, "records": 1, "bytes": 3, "sha1": "-"}], warc._REPORT)
    for _ in range(2):
        assert [x.num_rows for x in warc._publish(d)([b])] == [1]
    with open(f"{d}/n", "ab") as f:
        f.write(b"x")
    with pytest.raises(OSError):
        list(warc._publish(d)([b]))


def test_no_rows(spark, tmp_path):
    warc.write_warc(frame(spark, [(1, "u", "x")]).where("1 = 0"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
