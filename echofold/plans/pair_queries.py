"""Sources, scalar derivations, passes and pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from echofold.functions import columns as C
from echofold.operators import firn, interp, matching, pairs
from echofold.params import FirnParams
from echofold.plans import inputs as I
from echofold.plans.registry import query
from echofold.session import shared_folder
from echofold.sources import tables as S
from echofold.streaming.commits import read_commits, write_pairs
from echofold.streaming.incremental import missing

# --- sources and sinks ------------------------------------------------------


@query("read_products", ints="line_id n_pass", sql="""
SELECT l_suppkey AS line_id, count(DISTINCT year(l_shipdate)) AS n_pass FROM lineitem GROUP BY 1 HAVING count(DISTINCT year(l_shipdate)) >= 2""")
def _(t):
    got = S.read_products(t.spark, t.folder, tables={"lineitem": ["l_suppkey", "l_shipdate"]}, key="l_suppkey", suffix=".parquet")["lineitem"]
    return S.repeat_products(got.select(F.col("l_suppkey").alias("line_id"), I.year_pass().alias("pass_idx")))


# The month is a pass; a month whose mean discount is high counts as disabled.
MONTHS = """months AS (
  SELECT l_returnflag AS line_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS pass_idx,
         avg(l_discount) <= 0.0505 OR (year(l_shipdate) - 1995) * 12 + month(l_shipdate) = 5 AS enabled
  FROM lineitem GROUP BY 1, year(l_shipdate), month(l_shipdate))"""


def months(t):
    m = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int")
    d = t.lineitem.groupBy(F.col("l_returnflag").alias("line_id"), m.alias("pass_idx")).agg(F.avg("l_discount").alias("_d"))
    return d.select("line_id", "pass_idx", ((F.col("_d") <= 0.0505) | (F.col("pass_idx") == 5)).alias("enabled"))


@query("pass_slice_map", keys="line_id is_main", ints="pass_idx slice_idx", sql=f"""
WITH {MONTHS}
SELECT line_id, pass_idx, pass_idx = 5 AS is_main,
       CASE WHEN enabled THEN sum(CASE WHEN enabled THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY pass_idx) END AS slice_idx FROM months""")
def _(t):
    return pairs.pass_slice_map(months(t), 5)


@query("read_pair_outputs", ints="line ref_idx sec_idx", sql="""
SELECT CAST(regexp_extract(n, '^(.+)_pair_(\\d+)_(\\d+)', 1) AS BIGINT) AS line, regexp_extract(n, '^(.+)_pair_(\\d+)_(\\d+)', 2) AS ref_idx,
       regexp_extract(n, '^(.+)_pair_(\\d+)_(\\d+)', 3) AS sec_idx
FROM (SELECT l_suppkey || '_pair_' || l_linenumber || '_' || CAST(l_quantity AS INTEGER) AS n FROM lineitem)""")
def _(t):
    q = F.col("l_quantity").cast("int")
    names = t.lineitem.select(F.col("l_suppkey").cast("string").alias("line"),
                              F.concat_ws("_", "l_suppkey", F.lit("pair"), "l_linenumber", q).alias("name"))
    other = t.lineitem.select(F.col("l_suppkey").cast("string").alias("line"),
                              F.concat(F.lit("1"), F.concat_ws("_", "l_suppkey", F.lit("pair"), "l_linenumber", q)).alias("name"))
    return S.parse_pair_names(names.unionByName(other), "line")


@query("read_tide", digits={"ts_s": 0, "tide_m": 3}, sql="SELECT epoch_us(date_trunc('minute', ts)) / 1e6 AS ts_s, value AS tide_m FROM events")
def _(t):
    day = F.format_string("%.9f", C.epoch_us(F.date_trunc("minute", "ts").cast("timestamp_ntz")) / 8.64e10 + 719529)
    return S.parse_tide(t.events.select(F.concat_ws(",", day, F.lit("x"), F.col("value")).alias("value")))


@query("read_tide_sites", keys="site", digits={"ts_s": 1, "tide_m": 3}, sql="""
SELECT site, epoch_us(l_shipdate) / 1e6 AS ts_s, tide_m FROM (
  SELECT l_shipdate, 'G1' AS site, l_extendedprice AS tide_m FROM lineitem
  UNION ALL SELECT l_shipdate, 'G2', CASE WHEN l_discount = 0.05 THEN NULL WHEN l_tax = 0.02 THEN NULL ELSE l_discount END FROM lineitem)""")
def _(t):
    gap = F.when(F.col("l_discount") == 0.05, "NaN").when(F.col("l_tax") == 0.02, "").otherwise(F.col("l_discount").cast("string"))
    day = (C.epoch_us("l_shipdate") / 8.64e10 + 719529).cast("string")
    lines = t.lineitem.select(F.concat(day, F.lit(",iso,"), F.col("l_extendedprice").cast("string"), F.lit(","), gap).alias("value"))
    return S.parse_tide_sites(lines, ["G1", "G2"])


@query("read_stations", keys="site", digits={"x": 3, "y": 3}, sql="SELECT s_name AS site, s_acctbal AS x, CAST(s_suppkey AS DOUBLE) AS y FROM supplier")
def _(t):
    rows = t.supplier.select(F.concat_ws(" \t ", "s_acctbal", "s_suppkey", "s_name").alias("value"))
    heads = t.nation.select(F.concat(F.lit("# "), F.col("n_name")).alias("value")).unionByName(
        t.region.select(F.concat_ws(" ", F.lit("x y"), "r_name").alias("value")))
    return S.parse_stations(rows.unionByName(heads), ["x", "y", "site"], ["x", "y"])


@query("read_layers", ints="segment n", digits={"twtt": 4}, sql="""
SELECT l_suppkey AS segment, count(*) AS n, avg(l_tax) AS twtt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def _(t):
    picks = t.lineitem.select(F.col("l_suppkey").alias("segment"), F.col("l_returnflag").alias("layer_name"), F.col("l_tax").alias("twtt_s"))
    return S.pick_layer(picks, "R").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("twtt_s").alias("twtt"))


STATION_PAIRS = """spairs AS (
  SELECT CAST(user_id % 7 AS VARCHAR) AS site, epoch_us(ts) / 1e6 AS t1_s, round(value / 4000, 8) AS dt_days, round(value - 100, 3) AS vsr, event_type
  FROM events WHERE event_type <> 'error' AND round(value / 4000, 8) > 0.01 AND round(value / 4000, 8) < 0.1)"""


def station_pairs(t):
    """Station pair lines made from events; those of type 'error' carry a broken rate."""
    rate = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.round(F.col("value") - 100, 3).cast("string"))
    lines = t.events.select(F.concat_ws(",", (F.col("user_id") % 7).cast("string"), F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")),
                                        F.round(F.col("value") / 4000, 8).cast("string"), rate).alias("value"))
    return S.parse_station_pairs(lines).withColumn("t1_s", C.epoch_us("t1") / 1e6)


@query("read_station_pairs", keys="site", digits={"t1_s": 3, "dt_days": 8, "vsr": 3}, sql=f"WITH {STATION_PAIRS} SELECT * FROM spairs")
def _(t):
    return station_pairs(t)


@query("append_missing", ints="line_id ref_idx sec_idx", sql="""
SELECT l_orderkey AS line_id, l_linenumber AS ref_idx, CAST(l_quantity AS INTEGER) AS sec_idx FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_linestatus = 'F' AND d.l_orderkey = lineitem.l_orderkey AND d.l_linenumber = lineitem.l_linenumber
                  AND d.l_quantity = lineitem.l_quantity)""")
def _(t):
    todo = t.lineitem.select(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").alias("ref_idx"),
                             F.col("l_quantity").cast("int").alias("sec_idx"), "l_linestatus")
    return missing(todo, todo.where("l_linestatus = 'F'"))


@query("write_pairs", keys="input_build options", ints="line_id ref_idx sec_idx version", digits={"v": 2}, sql="""
SELECT l_orderkey AS line_id, l_linenumber AS ref_idx, CAST(l_quantity AS INTEGER) AS sec_idx, l_extendedprice AS v, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS version,
  CASE WHEN l_linestatus = 'F' THEN 'finished' ELSE 'all' END AS input_build, CASE WHEN l_linestatus = 'F' THEN '{}' ELSE '{"window": [5, 15]}' END AS options FROM lineitem WHERE l_linestatus = 'F' OR NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_linestatus = 'F' AND d.l_orderkey = lineitem.l_orderkey
    AND d.l_linenumber = lineitem.l_linenumber AND d.l_quantity = lineitem.l_quantity)""")
def _(t):
    # Two commits and a third run that has nothing to add, then all that is published.
    d = t.lineitem.select(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").alias("ref_idx"), F.col("l_quantity").cast("int").alias("sec_idx"), F.col("l_extendedprice").alias("v"), "l_linestatus")
    path = f"{shared_folder(t.spark)}/pairs-{uuid.uuid4().hex}"
    write_pairs(d.where("l_linestatus = 'F'"), path, "finished")
    for _ in range(2):
        write_pairs(d, path, "all", {"window": [5, 15]})
    return read_commits(t.spark, path)


@query("station_table_lines", keys="value", sql="""
SELECT p_brand || ' ' || printf('%.3f', regr_slope(v, q)) || ' ' || printf('%.3f', stddev_samp(v)) || ' ' || printf('%.3f', corr(v, q)) || ' ' || count(*) AS value
FROM (SELECT p_brand, l_extendedprice / 1e4 AS v, l_quantity / 10 AS q FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY p_brand""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", (F.col("l_extendedprice") / 1e4).alias("v"), (F.col("l_quantity") / 10).alias("q"))
    g = d.groupBy(F.col("p_brand").alias("site")).agg(F.regr_slope("v", "q").alias("mm_per_m"), F.stddev_samp("v").alias("sigma"),
                                                      F.corr("v", "q").alias("r2"), F.count(F.lit(1)).alias("n"))
    return S.station_lines(g)


@query("rerun_diff", keys="field", ints="n_diff", digits={"max_abs": 6}, sql="""
WITH a AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part),
b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 100 = 7 THEN p_size + 1 ELSE p_size END AS p_size,
             p_retailprice + CASE WHEN p_partkey % 50 = 3 THEN 0.5 ELSE 0.0000001 END AS p_retailprice FROM part WHERE p_partkey % 97 <> 5),
j AS (SELECT a.*, b.p_partkey AS k, b.p_brand AS b2, b.p_size AS s2, b.p_retailprice AS r2 FROM a FULL JOIN b ON a.p_partkey = b.p_partkey)
SELECT 'p_brand' AS field, sum(CASE WHEN k IS NOT NULL AND p_brand IS DISTINCT FROM b2 THEN 1 ELSE 0 END) AS n_diff, NULL::DOUBLE AS max_abs FROM j
UNION ALL SELECT 'p_size', sum(CASE WHEN k IS NOT NULL AND p_size IS DISTINCT FROM s2 THEN 1 ELSE 0 END), max(CASE WHEN k IS NOT NULL THEN abs(p_size - s2) END) FROM j
UNION ALL SELECT 'p_retailprice', sum(CASE WHEN k IS NOT NULL AND NOT abs(p_retailprice - r2) < 0.000001 THEN 1 ELSE 0 END), max(abs(p_retailprice - r2)) FROM j
UNION ALL SELECT '(rows)', sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END), NULL FROM j""")
def _(t):
    a = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    b = a.where(k % 97 != 5).withColumn("p_size", F.when(k % 100 == 7, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn(
        "p_retailprice", F.col("p_retailprice") + F.when(k % 50 == 3, 0.5).otherwise(0.0000001)).withColumn("extra", F.lit(1))
    return S.rerun_diff(a, b, ["p_partkey"], {"p_retailprice": 1e-6})


VERIFY = """a AS (SELECT o_custkey % 50 AS line, o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS part FROM orders),
b AS (SELECT line, o_orderkey, CASE WHEN line = 3 AND o_orderkey % 4 = 2 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice, CASE WHEN line = 7 THEN 'x' ELSE o_orderpriority END AS o_orderpriority, part
  FROM a WHERE NOT (line = 5 AND o_orderkey % 3 = 0))"""


@query("verify_rerun", keys="field", ints="n_diff", digits={"max_abs": 6}, sql=f"""
WITH {VERIFY}, j AS (SELECT a.*, b.o_orderkey AS k, b.o_totalprice AS p2, b.o_orderpriority AS q2, b.part AS t2 FROM a LEFT JOIN b USING (line, o_orderkey))
SELECT 'o_totalprice' AS field, sum(CASE WHEN k IS NOT NULL AND o_totalprice <> p2 THEN 1 ELSE 0 END) AS n_diff, max(abs(o_totalprice - p2)) AS max_abs FROM j
UNION ALL SELECT 'part', sum(CASE WHEN k IS NOT NULL AND part IS DISTINCT FROM t2 THEN 1 ELSE 0 END), max(abs(part - t2)) FROM j
UNION ALL SELECT 'o_orderpriority', sum(CASE WHEN k IS NOT NULL AND o_orderpriority <> q2 THEN 1 ELSE 0 END), NULL FROM j
UNION ALL SELECT '(rows)', sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END), NULL FROM j""")
def _(t):
    k, line, price = F.col("o_orderkey"), F.col("line"), F.col("o_totalprice")
    a = t.orders.select((F.col("o_custkey") % 50).alias("line"), "o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", price).alias("part"))
    b = a.where(~((line == 5) & (k % 3 == 0))).withColumn("o_totalprice", F.when((line == 3) & (k % 4 == 2), price + 0.5).otherwise(price)).withColumn(
        "o_orderpriority", F.when(line == 7, "x").otherwise(F.col("o_orderpriority")))
    return S.verify_rerun(a, b, ["line", "o_orderkey"], ["line"])


@query("line_catalog", ints="line_id n", digits={"v": 4}, sql="""
SELECT l_suppkey AS line_id, count(*) AS n, avg(l_quantity) AS v FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) GROUP BY 1""")
def _(t):
    catalog = t.supplier.select(F.col("s_suppkey").alias("line_id"), F.when(F.col("s_acctbal") < 1000, F.lit(0)).alias("duplicate_of"))
    d = t.lineitem.select(F.col("l_suppkey").alias("line_id"), "l_quantity")
    return S.without_duplicates(d, catalog).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("v"))


@query("line_dedupe", ints="day_seg t_key product pass_idx", digits={"t_start": 3}, sql="""
WITH one AS (SELECT l_linenumber AS product, l_suppkey AS day_seg, month(l_shipdate) AS pass_idx, avg(epoch_us(l_shipdate)) / 8.64e12 AS tm, min(epoch_us(l_shipdate)) / 8.64e12 AS t_start
             FROM lineitem GROUP BY 1, 2, 3)
SELECT day_seg, CAST(round(tm) AS BIGINT) AS t_key, product, pass_idx, t_start FROM one
QUALIFY row_number() OVER (PARTITION BY day_seg, round(tm) ORDER BY product, pass_idx) = 1""")
def _(t):
    d = t.lineitem.select(F.col("l_linenumber").alias("product"), F.col("l_suppkey").alias("day_seg"), F.month("l_shipdate").alias("pass_idx"),
                          (C.epoch_us("l_shipdate") / 8.64e12).alias("gps_time_s"))
    return S.dedupe_passes(d)


# --- scalar derivations -----------------------------------------------------


@query("usable_flags", ints="l_orderkey l_linenumber", keys="is_aligned zmotion", sql="""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END, CASE WHEN l_quantity > 10 THEN l_discount > 0.03 END, true) AS is_aligned,
       coalesce(CASE WHEN l_quantity > 25 THEN l_tax > 0.04 END, true) AS zmotion FROM lineitem""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("aligned"),
                          F.when(F.col("l_quantity") > 10, F.col("l_discount") > 0.03).alias("coalign_applied"),
                          F.when(F.col("l_quantity") > 25, F.col("l_tax") > 0.04).alias("_z"))
    return d.select("l_orderkey", "l_linenumber", C.is_aligned(d.columns).alias("is_aligned"), C.zmotion_applied(F.col("_z")).alias("zmotion"))


BASE = I.TRACKS + """, base AS (
  SELECT a.line_id, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx, a.col, b.ref_y - a.ref_y AS dy, b.ref_z - a.ref_z AS dz
  FROM tracks a JOIN tracks b ON a.line_id = b.line_id AND a.col = b.col AND a.pass_idx < b.pass_idx)"""


def line_passes(t):
    return t.lineitem.select(F.col("l_suppkey").alias("line_id"), I.year_pass().alias("pass_idx")).distinct()


@query("baseline_gate", keys="keep", ints="line_id ref_idx sec_idx", digits={"max_baseline": 6}, sql=f"""
WITH {BASE} SELECT line_id, ref_idx, sec_idx, max(abs(dy)) AS max_baseline, max(abs(dy)) <= 9.7777 AS keep FROM base GROUP BY 1, 2, 3""")
def _(t):
    tr = I.tracks(t)
    return pairs.baseline_gate(pairs.pair_baseline(tr, None, "ref_y").select(*pairs.PAIR).distinct(), pairs.pair_baseline(tr, None, "ref_y"), 9.7777)


@query("predicted_shift", ints="line_id ref_idx sec_idx", digits={"shift_ns": 6}, sql=f"""
WITH {BASE} SELECT line_id, ref_idx, sec_idx, -avg(dz) / (299792458.0 / 2) * 1e9 AS shift_ns FROM base GROUP BY 1, 2, 3""")
def _(t):
    b = pairs.pair_baseline(I.tracks(t), None, "ref_z").groupBy(*pairs.PAIR).agg(F.avg("baseline").alias("dz"))
    return b.select(*pairs.PAIR, (C.predicted_shift(F.col("dz"), F.lit(True)) * 1e9).alias("shift_ns"))


FIRN = FirnParams(max_depth=60.0, nz=601)
FIRN_CTE = """firn0 AS (
  SELECT i * 0.1 AS d, least(1.0 / (1 + exp(ln(1/0.35 - 1) + (ln(1/0.81 - 1) - ln(1/0.35 - 1)) * (i * 0.1) / 60.0)), 1.0) AS rho FROM range(601) AS r(i)),
firn1 AS (SELECT d, rho, 1 + 0.845 * rho * 0.917 AS n FROM firn0),
firn AS (SELECT d, rho, n, sum(coalesce((d - pd) * (n + pn) / 2, 0)) OVER (ORDER BY d) * 2 / 299792458.0 AS twtt,
                sum(coalesce((d - pd) * (g + pg) / 2, 0)) OVER (ORDER BY d) AS densify
         FROM (SELECT *, lag(d) OVER (ORDER BY d) AS pd, lag(n) OVER (ORDER BY d) AS pn, lag(g) OVER (ORDER BY d) AS pg
               FROM (SELECT *, 0.845 * 0.917 * 0.01 * greatest(0.0, 1 - d / 60.0) AS g FROM firn1)))"""


@query("firn_density_index", ints="l_partkey", digits={"rho": 6, "n_kov": 6, "n_loo": 6}, sql="""
SELECT l_partkey, rho, 1 + 0.845 * rho * 0.917 AS n_kov, pow(1 + rho * (pow(3.15, 1.0 / 3) - 1), 1.5) AS n_loo FROM (
  SELECT l_partkey, least(1.0 / (1 + exp(ln(1/0.35 - 1) + (ln(1/0.81 - 1) - ln(1/0.35 - 1)) * avg(l_quantity) / 60.0)), 1.0) AS rho FROM lineitem GROUP BY 1)""")
def _(t):
    d = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("d"))
    p = FirnParams()
    d = d.withColumn("rho", firn.density(F.col("d"), p))
    return d.withColumn("n_kov", firn.index_of(F.col("rho"), p)).withColumn("n_loo", firn.index_of(F.col("rho"), FirnParams(mixing="looyenga")))


def _interp(keys: str, key: str, table: str, on: str, val: str, out: str) -> str:
    """SQL for a linear read of a small table; NULL outside it."""
    return f"""SELECT k.*, CASE WHEN t.x0 = k.{key} THEN t.v0 ELSE t.v0 + (k.{key} - t.x0) * (t.v1 - t.v0) / (t.x1 - t.x0) END AS {out}
FROM {keys} k ASOF LEFT JOIN (SELECT {on} AS x0, {val} AS v0, lead({on}) OVER (ORDER BY {on}) AS x1, lead({val}) OVER (ORDER BY {on}) AS v1 FROM {table}) t ON k.{key} >= t.x0"""


DISPLACED = f"""{FIRN_CTE}, blk AS (SELECT l_suppkey AS line_id, CAST(l_quantity AS INTEGER) AS bin, avg(l_discount) * 1e-9 AS mean, stddev_pop(l_discount) * 1e-9 AS scatter,
  CAST(l_quantity AS INTEGER) * 1.1e-8 AS twtt, avg(epoch_us(l_shipdate)) / 1e6 - 8e8 AS dt_s FROM lineitem GROUP BY 1, 2, 5),
dep AS ({_interp('blk', 'twtt', 'firn', 'twtt', 'd', 'depth')}),
loc AS ({_interp('dep', 'depth', 'firn', 'd', 'n', 'n_local')}),
dis AS (SELECT *, mean * (299792458.0 / 2) / n_local AS dh, scatter * (299792458.0 / 2) / n_local AS dh_scatter FROM loc)"""


def _displaced(t, rate=None):
    q = F.col("l_quantity").cast("int")
    blk = t.lineitem.groupBy(F.col("l_suppkey").alias("line_id"), q.alias("bin")).agg(
        (F.avg("l_discount") * 1e-9).alias("mean"), (F.stddev_pop("l_discount") * 1e-9).alias("scatter"), (F.avg(C.epoch_us("l_shipdate")) / 1e6 - 8e8).alias("dt_s"))
    blk = blk.withColumn("std", F.col("scatter") / 2).withColumn("twtt", F.col("bin") * 1.1e-8)
    table = firn.firn_table(t.spark, FIRN, rate)
    return firn.to_displacement(blk, F.col("twtt"), table, FIRN), table


@query("geometric_dh", ints="line_id bin", digits={"depth": 5, "n_local": 6, "dh": 8, "dh_scatter": 8}, sql=f"WITH {DISPLACED} SELECT * FROM dis")
def _(t):
    return _displaced(t)[0]


@query("densification_correction", ints="line_id bin", digits={"dh": 8}, sql=f"""
WITH {DISPLACED}, c AS ({_interp('dis', 'depth', 'firn', 'd', 'densify', 'g')})
SELECT line_id, bin, dh - (2 / 299792458.0) * g * 0.25 * (299792458.0 / 2) / n_local AS dh FROM c""")
def _(t):
    d, table = _displaced(t, rate=0.01)
    return firn.densification_correction(d, table, F.lit(0.25), FIRN)


@query("velocity_rescale", ints="line_id bin", digits={"v": 8, "v_scatter": 8}, sql=f"""
WITH {DISPLACED} SELECT line_id, bin, dh / (dt_s / 31557600.0) AS v, dh_scatter / abs(dt_s / 31557600.0) AS v_scatter FROM dis WHERE dt_s <> 0""")
def _(t):
    d = _displaced(t)[0]
    return firn.to_velocity(d.drop("dt_s"), d.select("line_id", "bin", "dt_s"), ["line_id", "bin"])


@query("kz_factor", ints="l_partkey", digits={"kz": 6}, sql="SELECT l_partkey, -4 * pi() * 7.5e8 * (1 + avg(l_tax) * 10) / 299792458.0 AS kz FROM lineitem GROUP BY 1")
def _(t):
    d = t.lineitem.groupBy("l_partkey").agg((1 + F.avg("l_tax") * 10).alias("n"))
    return d.select("l_partkey", C.kz(F.lit(7.5e8), F.col("n")).alias("kz"))


@query("expected_curves", ints="l_partkey", digits={"tide_mm": 5, "secular_mm": 5}, sql="""
SELECT l_partkey, 1e3 * (-0.3 / 0.7) * (140.0 / (1500.0 * 1500.0)) * (1 - d / 280.0) * d AS tide_mm,
       -1e3 * 0.2 * (917.0 / 350.0 - 1) * 21.0 / 365.25 * least(d / 60.0, 1.0) AS secular_mm FROM (SELECT l_partkey, sum(l_quantity) / 10 AS d FROM lineitem GROUP BY 1)""")
def _(t):
    d = t.lineitem.groupBy("l_partkey").agg((F.sum("l_quantity") / 10).alias("depth"))
    return firn.expected_curves(d, 280.0, 1500.0, 0.3, 0.2, 60.0, 350.0, 21.0)


GEO = "(SELECT c_custkey, -77.0 - c_acctbal / 10000 AS lat, 160.0 + c_nationkey / 2.0 AS lon FROM customer)"


def geo(t):
    return t.customer.select("c_custkey", (-77.0 - F.col("c_acctbal") / 10000).alias("lat"), (160.0 + F.col("c_nationkey") / 2).alias("lon"))


@query("polar_stereo_xy", ints="c_custkey", digits={"x": 3, "y": 3}, sql=f"""
WITH k AS (SELECT 6378137.0 AS a, sqrt((1/298.257223563) * (2 - 1/298.257223563)) AS e),
c AS (SELECT *, tan(pi()/4 - radians(71)/2) / pow((1 - e * sin(radians(71))) / (1 + e * sin(radians(71))), e/2) AS tc, cos(radians(71)) / sqrt(1 - pow(e * sin(radians(71)), 2)) AS mc FROM k),
p AS (SELECT g.*, c.a * c.mc / c.tc * tan(pi()/4 - radians(-lat)/2) / pow((1 - e * sin(radians(-lat))) / (1 + e * sin(radians(-lat))), e/2) AS rho FROM {GEO} g, c)
SELECT c_custkey, rho * sin(radians(lon)) AS x, rho * cos(radians(lon)) AS y FROM p""")
def _(t):
    d = geo(t)
    x, y = C.polar_stereo_xy(F.col("lat"), F.col("lon"))
    return d.select("c_custkey", x.alias("x"), y.alias("y"))


@query("local_metres", ints="c_custkey", digits={"east": 3, "north": 3}, sql=f"""
SELECT c_custkey, (lon - 165) * 111320 * cos(radians(-77.5)) AS east, (lat + 77.5) * 110540 AS north FROM {GEO}""")
def _(t):
    d = geo(t)
    e, n = C.local_metres(F.col("lat"), F.col("lon"), F.lit(-77.5), F.lit(165.0))
    return d.select("c_custkey", e.alias("east"), n.alias("north"))


@query("flip_seaward", ints="line_id block", digits={"x_sea": 4, "r_sea": 6}, sql="""
WITH b AS (SELECT l_suppkey AS line_id, CAST(l_quantity AS INTEGER) AS block, l_quantity * 500 AS xb, CASE WHEN count(*) > 4 THEN avg(l_discount) END AS lat,
                  CASE WHEN min(l_tax) < 0.03 THEN avg(l_extendedprice) / 1e4 END AS a FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT line_id, arg_min(lat, block) AS lat_a, arg_max(lat, block) AS lat_b, arg_min(xb, block) AS xa, arg_max(xb, block) AS xz FROM b
      WHERE a IS NOT NULL AND lat IS NOT NULL GROUP BY 1),
s AS (SELECT b.*, CASE WHEN lat_a > lat_b THEN xb - xa ELSE xz - xb END AS x_sea FROM b JOIN e USING (line_id))
SELECT line_id, block, x_sea, corr(CASE WHEN lat IS NOT NULL THEN a END, x_sea) OVER (PARTITION BY line_id) AS r_sea FROM s""")
def _(t):
    q = F.col("l_quantity").cast("int")
    b = t.lineitem.groupBy(F.col("l_suppkey").alias("line_id"), q.alias("block"), (F.col("l_quantity") * 500).alias("xb")).agg(
        F.when(F.count(F.lit(1)) > 4, F.avg("l_discount")).alias("lat"), F.when(F.min("l_tax") < 0.03, F.avg("l_extendedprice") / 1e4).alias("a"))
    return matching.orient_seaward(b, ["line_id"], strict=False)


# --- pairs ------------------------------------------------------------------


@query("pairs_main", keys="line_id", ints="ref_idx sec_idx", sql=f"""
WITH {MONTHS} SELECT line_id, 5 AS ref_idx, pass_idx AS sec_idx FROM months WHERE enabled AND pass_idx <> 5""")
def _(t):
    return pairs.make_pairs(months(t), "main", F.lit(5))


@query("pairs_sequential", keys="line_id", ints="ref_idx sec_idx", sql=f"""
WITH {MONTHS} SELECT * FROM (SELECT line_id, pass_idx AS ref_idx, lead(pass_idx) OVER (PARTITION BY line_id ORDER BY pass_idx) AS sec_idx FROM months WHERE enabled)
WHERE sec_idx IS NOT NULL""")
def _(t):
    return pairs.make_pairs(months(t), "sequential")


@query("pairs_all", keys="line_id", ints="ref_idx sec_idx", sql=f"""
WITH {MONTHS} SELECT a.line_id, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx FROM months a JOIN months b ON a.line_id = b.line_id AND a.pass_idx < b.pass_idx
WHERE a.enabled AND b.enabled""")
def _(t):
    return pairs.make_pairs(months(t), "all")


@query("pairs_explicit", keys="line_id", ints="ref_idx sec_idx", sql=f"""
WITH {MONTHS}, want AS (SELECT DISTINCT l_returnflag AS line_id, month(l_shipdate) AS ref_idx, CAST(l_quantity AS INTEGER) AS sec_idx FROM lineitem)
SELECT * FROM want w WHERE ref_idx <> sec_idx AND EXISTS (SELECT 1 FROM months m WHERE m.enabled AND m.line_id = w.line_id AND m.pass_idx = ref_idx)
AND EXISTS (SELECT 1 FROM months m WHERE m.enabled AND m.line_id = w.line_id AND m.pass_idx = sec_idx)""")
def _(t):
    want = t.lineitem.select(F.col("l_returnflag").alias("line_id"), F.month("l_shipdate").alias("ref_idx"), F.col("l_quantity").cast("int").alias("sec_idx")).distinct()
    return pairs.make_pairs(months(t), want)


@query("pair_samples", ints="line_id ref_idx sec_idx col", digits={"xr": 6, "xi": 6}, sql=f"""
WITH {I.PAIR_SAMPLES} SELECT line_id, ref_idx, sec_idx, col, sum(sec_re * ref_re + sec_im * ref_im) AS xr, sum(sec_im * ref_re - sec_re * ref_im) AS xi
FROM psamples GROUP BY 1, 2, 3, 4""")
def _(t):
    from echofold.operators.interferogram import explode_samples
    d = explode_samples(pairs.pair_samples(I.slc(t)))
    re, im = C.conj_product(F.col("sec_re"), F.col("sec_im"), F.col("ref_re"), F.col("ref_im"))
    return d.groupBy("line_id", "ref_idx", "sec_idx", "col").agg(F.sum(re).alias("xr"), F.sum(im).alias("xi"))


@query("repeat_interval", ints="line_id ref_idx sec_idx col", digits={"dt_s": 1}, sql=f"""
WITH {I.TRACKS}, main AS (SELECT line_id, col, along_m AS x FROM tracks WHERE pass_idx = 1),
keys AS (SELECT m.line_id, p.pass_idx, m.col, m.x FROM main m JOIN (SELECT DISTINCT line_id, pass_idx FROM tracks) p USING (line_id)),
tb AS (SELECT line_id, pass_idx, along_m AS x0, gps_time_s AS v0, lead(along_m) OVER w AS x1, lead(gps_time_s) OVER w AS v1, lag(along_m) OVER w AS xp, lag(gps_time_s) OVER w AS vp,
       row_number() OVER w AS rn FROM tracks WINDOW w AS (PARTITION BY line_id, pass_idx ORDER BY along_m)),
hd AS (SELECT * FROM tb WHERE rn = 1),
al AS (SELECT k.*, CASE WHEN t.x0 = k.x THEN t.v0 WHEN t.x1 IS NOT NULL THEN t.v0 + (k.x - t.x0) * (t.v1 - t.v0) / (t.x1 - t.x0)
   WHEN t.x0 IS NOT NULL AND t.xp IS NOT NULL THEN t.v0 + (k.x - t.x0) * (t.v0 - t.vp) / (t.x0 - t.xp) WHEN t.x0 IS NOT NULL THEN t.v0
   WHEN h.x1 IS NOT NULL THEN h.v0 + (k.x - h.x0) * (h.v1 - h.v0) / (h.x1 - h.x0) ELSE h.v0 END AS g
  FROM (SELECT keys.* FROM keys) k ASOF LEFT JOIN tb t ON k.line_id = t.line_id AND k.pass_idx = t.pass_idx AND k.x >= t.x0
  LEFT JOIN hd h ON k.line_id = h.line_id AND k.pass_idx = h.pass_idx)
SELECT a.line_id, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx, a.col, b.g - a.g AS dt_s FROM al a JOIN al b ON a.line_id = b.line_id AND a.col = b.col AND a.pass_idx < b.pass_idx""")
def _(t):
    tr = I.tracks(t, by_line=True)
    return pairs.repeat_interval(tr, None, tr.where("pass_idx = 1"))


@query("drop_flagged", ints="line_id ref_idx sec_idx", sql=f"""
WITH {I.TRACKS}, q AS (SELECT line_id, pass_idx FROM tracks GROUP BY 1, 2 HAVING avg(ref_y) < 4.7 OR avg(CASE WHEN ref_z > 0.35 THEN 1.0 ELSE 0.0 END) < 0.5)
SELECT a.line_id, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx FROM (SELECT DISTINCT line_id, pass_idx FROM tracks) a JOIN (SELECT DISTINCT line_id, pass_idx FROM tracks) b
ON a.line_id = b.line_id AND a.pass_idx < b.pass_idx WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.line_id = a.line_id AND q.pass_idx IN (a.pass_idx, b.pass_idx))""")
def _(t):
    q = I.tracks_in_row_order(t).groupBy("line_id", "pass_idx").agg(F.avg("ref_y").alias("q_med"), F.avg((F.col("ref_z") > 0.35).cast("double")).alias("frac_applied"))
    return pairs.drop_flagged(pairs.make_pairs(line_passes(t), "all"), pairs.auto_flagged(q, 4.7, 0.5))


@query("dominant_reference", ints="line_id ref_idx n_pairs", sql="""
SELECT line_id, ref_idx, n_pairs FROM (SELECT l_suppkey AS line_id, l_linenumber AS ref_idx, count(*) AS n_pairs FROM lineitem GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY n_pairs DESC, ref_idx) = 1""")
def _(t):
    return pairs.dominant_reference(t.lineitem.select(F.col("l_suppkey").alias("line_id"), F.col("l_linenumber").alias("ref_idx")))


# --- interpolation joins ----------------------------------------------------

TIDE = """tb AS (SELECT t AS x0, v AS v0, lead(t) OVER w AS x1, lead(v) OVER w AS v1, row_number() OVER w AS rn, count(*) OVER () AS n, lag(t) OVER w AS xp, lag(v) OVER w AS vp
  FROM (SELECT t, avg(value) AS v FROM ev WHERE event_type = 'view' GROUP BY 1) WINDOW w AS (ORDER BY t))"""
KEYS = "keys AS (SELECT event_id, t FROM ev WHERE event_type = 'purchase')"
MIDPOINT = "CASE WHEN t.x0 = k.t THEN t.v0 ELSE t.v0 + (k.t - t.x0) * (t.v1 - t.v0) / (t.x1 - t.x0) END"
ENDS = {
    "null": MIDPOINT,
    "hold": f"coalesce({MIDPOINT}, t.v0, h.v0)",
    "nearest": "CASE WHEN t.x0 IS NULL THEN h.v0 WHEN t.x1 IS NULL OR k.t - t.x0 <= t.x1 - k.t THEN t.v0 ELSE t.v1 END",
    "extrap": f"coalesce({MIDPOINT}, t.v0 + (k.t - t.x0) * (t.v0 - t.vp) / (t.x0 - t.xp), h.v0 + (k.t - h.x0) * (h.v1 - h.v0) / (h.x1 - h.x0))",
}
for _policy, _expr in ENDS.items():
    @query(f"interp_tide_{_policy}", ints="event_id", digits={"tide": 3}, sql=f"""
WITH {I.EVENTS}, {TIDE}, {KEYS} SELECT k.event_id, {_expr} AS tide FROM (SELECT * FROM keys) k ASOF LEFT JOIN tb t ON k.t >= t.x0 LEFT JOIN (SELECT * FROM tb WHERE rn = 1) h ON true""")
    def _(t, policy=_policy):
        return interp.interp_join(I.series(t, "purchase").select("event_id", "t"), I.series(t, "view"), "t", "value", policy=policy, out="tide")


@query("tide_at_pass", ints="line_id pass_idx", keys="pass_ok", digits={"tmid": 2, "tide_m": 3}, sql=f"""
WITH {I.EVENTS}, {TIDE}, p AS (SELECT user_id AS line_id, CAST(floor((t - 1704067200) / 172800) AS INTEGER) AS pass_idx, avg(t) AS t, avg(value) AS v FROM ev WHERE event_type = 'click' GROUP BY 1, 2)
SELECT k.line_id, k.pass_idx, k.v >= 40.003 AS pass_ok, k.t AS tmid, CASE WHEN k.v >= 40.003 THEN {MIDPOINT} END AS tide_m FROM (SELECT * FROM p) k ASOF LEFT JOIN tb t ON k.t >= t.x0""")
def _(t):
    p = I.series(t, "click").groupBy(F.col("user_id").alias("line_id"), F.floor((F.col("t") - 1704067200) / 172800).alias("pass_idx")).agg(F.avg("t").alias("t"), F.avg("value").alias("v"))
    d = interp.interp_join(p, I.series(t, "view"), "t", "value", out="h").withColumn("pass_ok", F.col("v") >= 40.003)
    return d.select("line_id", "pass_idx", "pass_ok", F.col("t").alias("tmid"), F.when(F.col("pass_ok"), F.col("h")).alias("tide_m"))


@query("tide_rate", ints="event_id", digits={"rate": 6}, sql=f"""
WITH {I.EVENTS}, {TIDE}, {KEYS} SELECT k.event_id, CASE WHEN t.rn >= 3 AND t.rn <= t.n - 2 THEN (t.v1 - t.vp) / (t.x1 - t.xp) END AS rate
FROM (SELECT * FROM keys) k ASOF LEFT JOIN tb t ON k.t <= t.x0""")
def _(t):
    tide = I.series(t, "view").groupBy("t").agg(F.avg("value").alias("value"))
    return interp.tide_rate(I.series(t, "purchase").select("event_id", "t"), tide, "t", "value")


@query("tide_rate_central", ints="event_id", digits={"rate": 6}, sql=f"""
WITH {I.EVENTS}, {TIDE}, hi AS (SELECT event_id, t + 1800 AS t FROM ev WHERE event_type = 'purchase'), lo AS (SELECT event_id, t - 1800 AS t FROM ev WHERE event_type = 'purchase'),
a AS (SELECT k.event_id, {MIDPOINT} AS v FROM (SELECT * FROM hi) k ASOF LEFT JOIN tb t ON k.t >= t.x0), b AS (SELECT k.event_id, {MIDPOINT} AS v FROM (SELECT * FROM lo) k ASOF LEFT JOIN tb t ON k.t >= t.x0)
SELECT a.event_id, (a.v - b.v) / 3600 AS rate FROM a JOIN b USING (event_id)""")
def _(t):
    return interp.tide_rate(I.series(t, "purchase").select("event_id", "t"), I.series(t, "view"), "t", "value", half_step=1800.0)


PROFILE = "prof AS (SELECT l_partkey AS row_key, l_quantity AS z, avg(l_extendedprice) / 1e4 AS v FROM lineitem GROUP BY 1, 2)"


def part_profile(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("row_key"), F.col("l_quantity").alias("z")).agg((F.avg("l_extendedprice") / 1e4).alias("v"))


@query("read_at_depth", ints="row_key", digits={"value": 10}, sql=f"""
WITH {PROFILE}, a AS (SELECT row_key, arg_max(z, z) FILTER (z <= 25.5) AS x0, arg_max(v, z) FILTER (z <= 25.5) AS v0, arg_min(z, z) FILTER (z >= 25.5) AS x1,
  arg_min(v, z) FILTER (z >= 25.5) AS v1 FROM prof GROUP BY 1)
SELECT row_key, v0 + (25.5 - x0) * (v1 - v0) / (x1 - x0) AS value FROM a WHERE x0 IS NOT NULL AND x1 IS NOT NULL""")
def _(t):
    return interp.read_at(part_profile(t), "z", "v", 25.5, ["row_key"])
