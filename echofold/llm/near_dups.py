"""Near-duplicate groups by a signature-coordinate inverted join.

A document's set holds the hashes of its distinct five-word shingles, its
signature the minimum of each of `COORDS` permutations over the set. Two sets
with Jaccard similarity s agree in each coordinate with probability s, so linked
texts agree in at least `matches_for(s)` of them but for a chance of at most
`MISS` at the very threshold.

1. Texts with the same words are one class; everything below is per class.
2. Every class is posted under each (coordinate, value) pair. Pairs are ranked
   by the length of their lists, shortest first. Two classes with `matches`
   agreements share one of the first COORDS - matches + 1 of each (prefix);
   pairs on one list only take places there and are skipped.
3. Classes that share their longest prefix list make up a cluster, dealt by a
   salt into chunks of bounded size; lists are joined chunk against chunk, so a
   group of any size is spread over many tasks and no row is made per pair.
4. In a pair of chunks the agreements of all pairs are counted on the
   signatures (the long lists, skipped in the join, are counted here), pairs below
   `matches` are dropped, and the rest are confirmed on their full sets. A
   spanning forest of the links leaves the task: as many rows as classes.
5. Components are found on the forest edges by rounds of star contractions.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import byte_texts, checkpointed, offsets, slices, small_batches, written
from echofold.llm.registry import query, table

WORDS = 5
COORDS = 64
#: Chance of a linked pair at the very threshold to agree in too few coordinates.
MISS = 2e-6
#: Shingles that a chunk of a cluster holds, about; what one side of a comparison weighs.
CHUNK = 200_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**64, 512, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**64, 512, dtype=np.uint64) | np.uint64(1)


def matches_for(num: int, den: int, coords: int = COORDS) -> int:
    """Agreements that a pair of similarity num / den reaches but for a chance of at most MISS: 39 of 64 at 0.85, 35 at 0.80."""
    s, below = num / den, 0.0
    for m in range(coords):
        below += comb(coords, m) * s**m * (1 - s) ** (coords - m)
        if below > MISS:
            return m
    return coords


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of the input."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class WordHashes:
    """64-bit hashes of words, with a bounded memo."""

    def __init__(self, most: int = 300_000):
        self.memo, self.most = {}, most

    def __call__(self, words: list[list[bytes]]) -> np.ndarray:
        new = set().union(*words).difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo = {}
            new = set().union(*words)
        known = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in new}
        self.memo.update(known)
        look = self.memo.__getitem__
        return np.fromiter((h for ws in words for h in map(look, ws)), dtype=np.uint64, count=sum(map(len, words)))


def shingles(words: list[list[bytes]], hashes: WordHashes, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, flat and sorted within it; offsets; a 64-bit hash of the word sequence.

    A text of fewer words than `n` has its whole sequence as its one shingle, one without words has none.
    """
    size = np.array([len(w) for w in words], dtype=np.int64)
    flat = hashes(words)
    off = offsets(size)
    short = (size > 0) & (size < n)
    count = np.where(size >= n, size - n + 1, short.astype(np.int64))
    h = np.zeros(int(count.sum()), dtype=np.uint64)
    out = offsets(count)
    starts = np.repeat(off[:-1] - out[:-1], count) + np.arange(len(h))
    long_ = np.repeat(~short, count)
    base = starts[long_]
    part = np.zeros(len(base), dtype=np.uint64)
    for k in range(n):
        part += flat[base + k] * _MULT[k % 5] + np.uint64(k // 5)
    h[long_] = mixed(part)
    for i in np.flatnonzero(short):
        p = flat[off[i]:off[i + 1]]
        h[out[i]] = mixed(np.array([int((p * _MULT[:len(p)]).sum(dtype=np.uint64)) ^ len(p)], dtype=np.uint64))[0]
    row = np.repeat(np.arange(len(words)), count)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], offsets(np.bincount(row[first], minlength=len(words))), size


def signatures(h: np.ndarray, off: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Minima of each permutation over each set, upper halves; the row of an empty set is zero."""
    out = np.zeros((len(off) - 1, coords), dtype=np.uint32)
    size = np.diff(off)
    full = np.flatnonzero(size)
    for i, j in slices(size[full].tolist(), 1 << 16):
        rows = full[i:j]
        part = h[off[rows[0]]:off[rows[-1] + 1]]
        start = off[rows] - off[rows[0]]
        tmp = np.empty_like(part)
        for k in range(coords):
            np.bitwise_xor(part, _XOR[k], out=tmp)
            np.multiply(tmp, _MUL[k], out=tmp)
            out[rows, k] = np.minimum.reduceat(tmp, start) >> np.uint64(32)
    return out


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def class_key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sign(coords: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            ids, text, text_key = b.column(0), byte_texts(b), b.column(2)
            for i, j in slices([len(t) for t in text], 2_000_000):
                words = [words_of(t) for t in text[i:j]]
                h, off, _ = shingles(words, hashes)
                sig = signatures(h, off, coords)
                size = np.diff(off)
                key = pa.array([class_key(w) if w else None for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(size, pa.int64()), key, pa.array([s.tobytes() if n else None for s, n in zip(sig, size, strict=True)], pa.binary()), text_key[i:j]],
                    ["doc_id", "n_shingles", "key", "sig", "text_key"])
    return run


def signed(docs: DataFrame, coords: int = COORDS) -> DataFrame:
    """(doc_id, n_shingles, key, sig, text_key) per row; key and sig are NULL for a text without words."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key")).mapInArrow(
        _sign(coords), f"doc_id {kind}, n_shingles long, key binary, sig binary, text_key long")


def _post(coords: int):
    """One row per (class, coordinate): a 64-bit name of the pair, the class, its size."""
    salt = mixed(np.arange(1, coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(n, coords)
            pair = mixed(sig.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ salt).astype(np.int64)
            take = pa.array(np.repeat(np.arange(n), coords))
            yield pa.RecordBatch.from_arrays([pa.array(pair.ravel()), b.column(0).take(take), b.column(2).take(take)], ["pair", "node", "n_shingles"])
    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges (a, b) make up a spanning forest of n nodes."""
    parent, keep = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(e)
    return keep


def _compare(coords: int, matches: int, num: int, den: int):
    """Links between (or within) two chunks, as a spanning forest."""

    def run(left: pa.Table) -> pa.Table:
        t = left.combine_chunks()
        keys, side = np.array(t.column("key").to_pylist(), dtype=object), t.column("side").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint32).reshape(len(keys), coords)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        code = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
        off = offsets(size)
        rows = np.flatnonzero(side == 0)
        others = np.flatnonzero(side == 1)
        within = not len(others)
        if within:
            others = rows
        mark = np.zeros(int(code.max()) + 1 if len(code) else 0, dtype=bool)
        theirs = np.ascontiguousarray(sig[others].T)
        ea, eb = [], []
        for r in rows:
            same = np.zeros(len(others), dtype=np.int16)
            for k in range(coords):
                same += theirs[k] == sig[r, k]
            smaller, larger = np.minimum(size[others], size[r]), np.maximum(size[others], size[r])
            hit = others[(same >= matches) & (den * smaller >= num * larger)]
            hit = hit[hit > r] if within else hit
            if not len(hit):
                continue
            mark[code[off[r]:off[r + 1]]] = True
            flat = np.concatenate([code[off[x]:off[x + 1]] for x in hit])
            common = np.add.reduceat(mark[flat].astype(np.int64), offsets(size[hit])[:-1])
            mark[code[off[r]:off[r + 1]]] = False
            ok = hit[den * common >= num * (size[hit] + size[r] - common)]
            ea.append(np.full(len(ok), r))
            eb.append(ok)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ea, eb))
        e = _forest(len(keys), a, b)
        return pa.table({"a": pa.array(keys[a[e]].tolist(), pa.binary()), "b": pa.array(keys[b[e]].tolist(), pa.binary())})
    return run


def _sets():
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            text = byte_texts(b)
            for i, j in slices([len(t) for t in text], 2_000_000):
                words = [words_of(t) for t in text[i:j]]
                h, off, _ = shingles(words, hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_key(w) if w else None for w in words], pa.binary()),
                     pa.array([h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["key", "shingles"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Large-star and small-star rounds alternate until nothing moves; each round
    is written to the shared folder. A node's neighbours are never gathered:
    stars are formed by an aggregate and a join, which splits skewed keys.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        new = checkpointed(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        # A forest of stars: no parent has a parent, and no node has two.
        deep = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = new.groupBy("u").count().where("count > 1").limit(1).count()
        e = new
        if not deep and not many:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest_edges(docs: DataFrame, table_: DataFrame, num: int, den: int, coords: int = COORDS, matches: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between class keys whose components are those of all links."""
    matches = matches_for(num, den, coords) if matches is None else matches
    classes = table_.where("key is not null").groupBy("key").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"))
    node = F.xxhash64("key")
    posts = classes.select(node.alias("node"), "sig", "n_shingles").mapInArrow(_post(coords), "pair long, node long, n_shingles long")
    posts = posts.repartition("pair")
    lists = posts.groupBy("pair").agg(F.count(F.lit(1)).alias("df"), F.sum("n_shingles").alias("weight")).where("df > 1")
    shared = written(posts.join(lists, "pair").select("node", "pair", "df", "weight"), "postings")
    # The rarest pairs of a class are those on no other list: they fill the prefix first.
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "pair"))
    n = F.count(F.lit(1)).over(Window.partitionBy("node"))
    top = F.max(F.struct("df", "pair", "weight"))
    prefix = shared.select("*", rank.alias("r"), n.alias("n")).where(F.col("r") + (coords - F.col("n")) <= coords - matches + 1)
    prefix = written(prefix.select("node", "pair", "df", "weight"), "prefix")
    cluster = prefix.groupBy("node").agg(top.alias("c")).select("node", F.col("c.pair").alias("cluster"), F.ceil(F.col("c.weight") / chunk).alias("k"))
    cluster = cluster.select("node", F.xxhash64("cluster", F.pmod(F.xxhash64("node", F.lit(5)), F.col("k"))).alias("chunk"))
    cluster = checkpointed(cluster)
    on = prefix.join(cluster, "node").select("pair", "chunk").distinct()
    pairs = on.withColumnRenamed("chunk", "x").join(on.withColumnRenamed("chunk", "y"), "pair").where("x <= y").select("x", "y").distinct()
    pairs = checkpointed(pairs)
    wanted = classes.select("key", "sig", "doc_id", node.alias("node")).join(cluster, "node")
    full = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(), "key binary, shingles binary")
    members = written(wanted.select("key", "sig", "chunk").join(full.dropDuplicates(["key"]), "key"), "members")
    left = pairs.join(members, pairs.x == members.chunk).select("x", "y", F.lit(0).alias("side"), "key", "sig", "shingles")
    right = pairs.where("x <> y").join(members, F.col("y") == members.chunk).select("x", "y", F.lit(1).alias("side"), "key", "sig", "shingles")
    return left.unionByName(right).groupBy("x", "y").applyInArrow(_compare(coords, matches, num, den), "a binary, b binary")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """Per row: (doc_id, n_shingles, component_id, kept, text_key); links are den * common >= num * union.

    component_id is the smallest id reachable over links, kept whether that is
    the row's own. A text without words is linked with nothing. Rows repeated
    whole stay repeated; rows of one id with different texts are linked each on
    its own. A row without id belongs to no component: component_id NULL, kept.
    """
    rows = written(signed(docs), "signatures")
    own = rows.where("doc_id is not null")
    comp = components(forest_edges(docs, own, num, den))
    ids = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("lowest"))
    named = ids.join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "lowest", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    found = named.join(least, "component").select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key", "text_key").join(found, "key", "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"), "text_key")


def one_of_each(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """The documents with one of each near-duplicate group, all columns; links as in `near_duplicates`.

    Rows repeated whole (id and text) are reduced to one as well; rows without an id stay.
    """
    kept = near_duplicates(docs, num, den).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    kept = written(kept, "kept")
    again = kept.where("_n > 1 and _id is not null").limit(1).count()
    out = docs.join(kept.drop("_n"), docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_key"]), "left_semi")
    if not again:
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id is null"))


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS p, b.doc_id AS q FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT p, q FROM c UNION ALL SELECT q, p FROM c),
r AS (
  WITH RECURSIVE reach(doc_id, least) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT e.q, reach.least FROM reach JOIN e ON reach.doc_id = e.p WHERE reach.least < e.q)
  SELECT doc_id, min(least) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM s JOIN r USING (doc_id)
"""


@query("op2_near_dups", SQL)
def op2_near_dups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")
