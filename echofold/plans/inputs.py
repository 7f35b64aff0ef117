"""The engine's inputs derived from the given tables, as DataFrames and as SQL.

tracks    ship lines of a supplier as a line, the year as the pass, the quantity as the column
samples   embedding vectors as traces: 400 vectors make a line of 4 passes, 64 bins a trace
series    event values of a type over time
pairdiff  yearly price differences of the parts of a brand: pair measurements of a network
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions.columns import epoch_us, mean_in_order
from echofold.operators.pairs import pair_samples
from echofold.plans.registry import Tables

TRACKS = """tracks AS (
  SELECT l_suppkey AS line_id, CAST(year(l_shipdate) - 1994 AS INTEGER) AS pass_idx, CAST(l_quantity AS INTEGER) AS col,
         CAST(l_quantity AS INTEGER) * 2.5 AS along_m, avg(l_discount) * 100 AS ref_y, avg(l_tax) * 10 AS ref_z,
         avg(epoch_us(l_shipdate)) / 1e6 AS gps_time_s, avg(l_extendedprice) / 9973 AS v
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def year_pass(ts: str = "l_shipdate"):
    return (F.year(ts) - 1994).cast("int")


def tracks(t: Tables, by_line: bool = False) -> DataFrame:
    """The tracks; by_line exchanges the ship lines by line first, for queries that stay within lines."""
    q = F.col("l_quantity").cast("int")
    return (t.lineitem.repartition("l_suppkey") if by_line else t.lineitem).groupBy(
        F.col("l_suppkey").alias("line_id"), year_pass().alias("pass_idx"), q.alias("col")
    ).agg((F.avg("l_discount") * 100).alias("ref_y"), (F.avg("l_tax") * 10).alias("ref_z"),
          (F.avg(epoch_us("l_shipdate")) / 1e6).alias("gps_time_s"), (F.avg("l_extendedprice") / 9973).alias("v")
          ).withColumn("along_m", F.col("col") * 2.5)


def tracks_in_row_order(t: Tables) -> DataFrame:
    """ref_y and ref_z of the tracks, for thresholds that many means lie on but for rounding.

    The ship lines of a track are added in the order of the table's rows (files by
    name), as SQL adds them on one thread, so no split of the table decides a tie. A
    track's lines, those of one supplier, year and quantity, are held as one array.
    """
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("line_id"), year_pass().alias("pass_idx"), F.col("l_quantity").cast("int").alias("col"),
        F.struct("_metadata.file_path", "_metadata.row_index", F.col("l_discount").alias("y"), F.col("l_tax").alias("z")).alias("_r"))
    d = rows.repartition("line_id").groupBy("line_id", "pass_idx", "col").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return d.select("line_id", "pass_idx", "col", (mean_in_order(F.col("_r.y")) * 100).alias("ref_y"), (mean_in_order(F.col("_r.z")) * 10).alias("ref_z"))


SAMPLES = """samples AS (
  SELECT vec_id // 400 AS line_id, CAST(vec_id % 4 AS INTEGER) AS pass_idx, CAST((vec_id % 400) // 4 AS INTEGER) AS col,
         CAST(b AS INTEGER) AS bin, CAST(embedding[b + 1] AS DOUBLE) AS re, CAST(embedding[(b + 21) % 64 + 1] AS DOUBLE) AS im
  FROM embeddings, range(64) AS r(b))"""

PAIR_SAMPLES = SAMPLES + """, psamples AS (
  SELECT a.line_id, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx, a.col, a.bin,
         a.re AS ref_re, a.im AS ref_im, b.re AS sec_re, b.im AS sec_im
  FROM samples a JOIN samples b ON a.line_id = b.line_id AND a.col = b.col AND a.bin = b.bin AND a.pass_idx < b.pass_idx)"""


def slc(t: Tables) -> DataFrame:
    """Packed traces (line_id, pass_idx, col, re, im)."""
    v = F.col("vec_id")
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select(F.floor(v / 400).alias("line_id"), (v % 4).cast("int").alias("pass_idx"),
                               F.floor((v % 400) / 4).cast("int").alias("col"), e.alias("re"), F.concat(F.slice(e, 22, 43), F.slice(e, 1, 21)).alias("im"))


def samples(t: Tables) -> DataFrame:
    z = slc(t).select("line_id", "pass_idx", "col", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "_s"))
    return z.select("line_id", "pass_idx", "col", "bin", "_s.re", "_s.im")


def main_samples(t: Tables) -> DataFrame:
    """Sample pairs of every pass with pass 0."""
    from echofold.operators.interferogram import explode_samples
    return explode_samples(pair_samples(slc(t), mode="main", main_idx=0))


# A made surface bin per column: it wanders over bins 8..23 and is missing for some columns.
REF_BINS = """ref_bins AS (
  SELECT DISTINCT line_id, col, CASE WHEN col % 11 = 5 THEN NULL ELSE 8 + col % 16 END AS ref_bin FROM samples)"""


def ref_bins(t: Tables) -> DataFrame:
    c = F.col("col")
    return slc(t).select("line_id", "col").distinct().withColumn("ref_bin", F.when(c % 11 != 5, 8 + c % 16).cast("int"))


PAIRDIFF = """yearly AS (
  SELECT p_brand AS row_key, l_partkey AS part, CAST(year(l_shipdate) - 1994 AS INTEGER) AS pass_idx, avg(l_extendedprice) / 1e4 AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
pairdiff AS (
  SELECT a.row_key, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx, avg(b.v - a.v) AS d, count(*) AS n
  FROM yearly a JOIN yearly b ON a.row_key = b.row_key AND a.part = b.part AND a.pass_idx < b.pass_idx GROUP BY 1, 2, 3)"""


def pairdiff(t: Tables) -> DataFrame:
    y = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("row_key"), F.col("l_partkey").alias("part"), year_pass().alias("pass_idx")
    ).agg((F.avg("l_extendedprice") / 1e4).alias("v"))
    p = pair_samples(y, key=["row_key", "part"], values=["v"])
    return p.groupBy("row_key", "ref_idx", "sec_idx").agg(F.avg(F.col("sec_v") - F.col("ref_v")).alias("d"), F.count(F.lit(1)).alias("n"))


EVENTS = "ev AS (SELECT event_id, event_type, user_id, epoch_us(ts) / 1e6 AS t, value FROM events)"


def events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", "user_id", (epoch_us("ts") / 1e6).alias("t"), "value")


def series(t: Tables, kind: str) -> DataFrame:
    return events(t).where(F.col("event_type") == kind).select("event_id", "user_id", "t", "value")
