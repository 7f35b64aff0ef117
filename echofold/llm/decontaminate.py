"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

Words are letters and digits in lower case; a shingle is five of them (an item
of fewer words is one shingle).

1. Windows as long as an item are taken where a document shares a shingle with
   the benchmark, aligned to the item's place of it. A window without a shared
   shingle has similarity 0, so none is missed.
2. Windows and items get a 64-bit SimHash of their words.
3. Two fingerprints within `RADIUS` differ by at most RADIUS // 4 bits in one of four
   16-bit blocks. Items are posted under every value that close to their own,
   windows under their own value: the join finds all fingerprints within the radius.
4. Candidates are verified by their weighted shingle similarity, the sum of the smaller
   counts over the sum of the larger ones, in whole numbers.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.registry import query, table

WORDS = 5
BLOCKS, BITS = 4, 16
RADIUS = 15
#: Similarity NUM / DEN or more is contamination.
NUM, DEN = 4, 5
#: Benchmark shingles up to this number are broadcast (16 bytes each and overhead); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles(ws: Column, n: int) -> Column:
    """Hashes of all runs of n words, in their order; none where there are fewer words."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(ws, i, n))))
                  ).otherwise(F.array().cast("array<bigint>"))


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def simhash(ws: Column) -> Column:
    """64 bits: bit j is set where most of the words' hashes have it set."""
    def bits(hashes):
        def bit(j):
            ones = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + F.call_function("shiftright", h, j).bitwiseAND(F.lit(1)))
            return F.when(ones * 2 > F.size(hashes), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, j: a.bitwiseOR(F.call_function("shiftleft", bit(j), j)))

    return bound(F.transform(ws, lambda w: F.xxhash64(w)), bits)


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1))


def near_masks(distance: int) -> list[int]:
    """All masks of up to `distance` bits within a block."""
    return [sum(1 << b for b in c) for n in range(distance + 1) for c in combinations(range(BITS), n)]


def overlap(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller count."""
    def times(xs, d):
        return F.size(F.filter(xs, lambda x: x == d))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, d: s + F.least(times(a, d), times(b, d)))


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, w, n (words), k (words of a shingle), sh."""
    one = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    one = one.withColumn("n", F.size("w")).withColumn("k", F.least(F.col("n"), F.lit(WORDS)))
    sh = F.lit(None).cast("array<bigint>")
    for k in range(WORDS, 0, -1):
        sh = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(sh)
    return one.withColumn("sh", sh)


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows that share a shingle with an item: (doc_id, text_key, start, n, k, w), each once."""
    ks = sorted(r[0] for r in items.select("k").distinct().collect()) or [WORDS]  # at most WORDS values
    index = items.select("n", "k", F.posexplode("sh").alias("q", "h")).distinct()
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    base = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))
    # Texts stay where they are: only ids, places and hashes of shingles become rows.
    cut = base.select("doc_id", "text_key", words(F.col("text")).alias("w"))
    places = None
    for k in ks:
        rows = cut.select("doc_id", "text_key", F.size("w").alias("nd"), F.posexplode(shingles(F.col("w"), k)).alias("p", "h"))
        met = rows.join(index.where(F.col("k") == k), "h")
        start = F.greatest(F.least(F.col("p") - F.col("q"), F.col("nd") - F.col("n")), F.lit(0))
        one = met.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), start.alias("start"), "n", "k")
        places = one if places is None else places.unionByName(one)
    places = places.distinct()
    met = base.join(places, base["doc_id"].eqNullSafe(places["_id"]) & (base["text_key"] == places["_key"]))
    return met.select("doc_id", "text_key", "start", "n", "k", F.slice(words(F.col("text")), F.col("start") + 1, F.col("n")).alias("w"))


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Items found in documents: (doc_id, text_key, item_id, start, n_words, similarity), the best window of each.

    start counts words. A text shorter than the item is compared whole. NULL and
    empty texts and items match nothing; equal items are found under each of their
    ids; rows of one id with the same text give one result, with different texts one each.
    """
    items = _items(benchmark)
    fp = simhash(F.col("w"))
    masks = near_masks(radius // BLOCKS)
    marked = items.select("item_id", "n", "sh", fp.alias("fp"))
    posts = marked.select("*", F.posexplode(F.array(*[block(F.col("fp"), k) for k in range(BLOCKS)])).alias("blk", "own")).select(
        "item_id", "n", "fp", "blk", F.explode(F.lit(masks).cast("array<bigint>")).alias("m"), "own").select(
        F.col("item_id"), F.col("n"), F.col("fp").alias("item_fp"), "blk", F.col("own").bitwiseXOR(F.col("m")).alias("value"))
    seen = windows(docs, items).withColumn("fp", fp)
    asked = seen.select("*", F.posexplode(F.array(*[block(F.col("fp"), k) for k in range(BLOCKS)])).alias("blk", "value"))
    # Posts are hundreds of rows for each item, more than the planner expects: never broadcast.
    near = asked.join(posts.hint("merge"), ["n", "blk", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    whole = marked.select(F.col("item_id").alias("_id"), F.col("n").alias("_n"), F.col("fp").alias("_fp"), F.col("sh").alias("item_sh"))
    near = near.drop("blk", "value").distinct().join(whole, F.col("item_id").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n")) & (F.col("item_fp") == F.col("_fp")))
    sh = F.lit(None).cast("array<bigint>")
    for k in range(WORDS, 0, -1):
        sh = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(sh)
    both = near.withColumn("sh", sh).withColumn("common", overlap(F.col("sh"), F.col("item_sh")))
    total = F.size("sh") + F.size("item_sh") - F.col("common")
    hit = both.withColumn("total", total).where(F.col("common") * DEN >= F.col("total") * NUM)
    best = F.max_by(F.struct("start", "n", "common", "total"), F.struct(F.col("common") / F.col("total"), -F.col("start"))).alias("b")
    return hit.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", F.col("b.start").cast("bigint").alias("start"), F.col("b.n").cast("bigint").alias("n_words"),
        F.round(F.col("b.common") / F.col("b.total"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, all columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
ish AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS q, w FROM iw WHERE len(w) >= 5),
ix AS (SELECT item_id, n, q, array_to_string(w[q + 1:q + 5], ' ') AS g FROM ish),
dsh AS (SELECT doc_id, len(w) AS nd, unnest(range(0, len(w) - 4)) AS p, w FROM dw WHERE len(w) >= 5),
dx AS (SELECT doc_id, nd, p, g FROM (SELECT doc_id, nd, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM dsh)),
win AS (SELECT DISTINCT doc_id, n, greatest(0, least(p - q, nd - n)) AS start FROM dx JOIN ix USING (g)),
dl AS (SELECT DISTINCT doc_id FROM win),
wc AS (SELECT win.doc_id, win.n, win.start, dx.g, count(*) AS c FROM win JOIN dx ON dx.doc_id = win.doc_id AND dx.p >= win.start AND dx.p <= win.start + win.n - 5 GROUP BY ALL),
wt AS (SELECT doc_id, n, start, sum(c) AS t FROM wc GROUP BY ALL),
ic AS (SELECT item_id, n, g, count(*) AS c FROM ix GROUP BY ALL),
it AS (SELECT item_id, sum(c) AS t FROM ic GROUP BY ALL),
cm AS (SELECT wc.doc_id, wc.n, wc.start, ic.item_id, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic ON wc.g = ic.g AND wc.n = ic.n GROUP BY ALL),
r AS (SELECT cm.doc_id, cm.item_id, cm.start, cm.n, common, wt.t + it.t - common AS total FROM cm JOIN wt USING (doc_id, n, start) JOIN it USING (item_id)
  WHERE common * 5 >= (wt.t + it.t - common) * 4)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_words, round(CAST(common AS DOUBLE) / CAST(total AS DOUBLE), 6) AS similarity
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(common AS DOUBLE) / CAST(total AS DOUBLE) DESC, start) = 1
"""


@query("op8_decontamination", SQL)
def op8_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
