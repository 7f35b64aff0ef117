"""Stacks, matches by position, change points, profiles and the modulus fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.operators import blocks, coherent, flexure, matching, network, profiles
from echofold.operators.scan import Scan, ordered
from echofold.plans import chains
from echofold.plans import inputs as I
from echofold.plans.registry import query
from echofold.plans.signal_queries import MONTHLY, monthly

# Per part: a value with its sigma and a position.
VS = "vs AS (SELECT p_partkey AS id, p_brand AS line_id, p_size AS x, p_retailprice AS rp, avg(l_extendedprice) / 1e4 AS v, stddev_samp(l_extendedprice) / 1e4 AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4)"


def values(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("line_id"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("rp")).agg(
        (F.avg("l_extendedprice") / 1e4).alias("v"), (F.stddev_samp("l_extendedprice") / 1e4).alias("s"))


@query("inverse_variance_mean", keys="line_id", ints="n", digits={"mean": 7, "formal": 7, "scatter": 7, "err": 7}, sql=f"""
WITH {VS} SELECT line_id, count(*) AS n, sum(v / (s * s)) / sum(1 / (s * s)) AS mean, 1.4 * sqrt(1 / sum(1 / (s * s))) AS formal, stddev_samp(v) / sqrt(count(*)) AS scatter,
 greatest(1.4 * sqrt(1 / sum(1 / (s * s))), stddev_samp(v) / sqrt(count(*))) AS err FROM vs WHERE s > 0 GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return blocks.inverse_variance_mean(values(t), "v", "s", ["line_id"], inflate=1.4)


STACK = VS + ", sb AS (SELECT x // 4 AS bin, count(*) AS n, (x // 4 + 0.5) * 4 AS centre, sum(v / (s * s)) / sum(1 / (s * s)) AS mean, sqrt(1 / sum(1 / (s * s))) AS std FROM vs WHERE s > 0 GROUP BY x // 4 HAVING count(*) >= 2)"


@query("stack_bins", ints="bin n", digits={"centre": 2, "mean": 8, "std": 8}, sql=f"WITH {STACK} SELECT * FROM sb")
def _(t):
    return blocks.stack_bins(values(t), "x", "v", "s", 4.0)


@query("value_at_position", keys="how", digits={"v": 8, "e": 8}, sql=f"""
WITH {STACK}, a AS (SELECT * FROM sb WHERE centre <= 17.3 ORDER BY centre DESC LIMIT 1), b AS (SELECT * FROM sb WHERE centre >= 17.3 ORDER BY centre LIMIT 1)
SELECT 'interpolated' AS how, a.mean + (17.3 - a.centre) / (b.centre - a.centre) * (b.mean - a.mean) AS v, a.std + (17.3 - a.centre) / (b.centre - a.centre) * (b.std - a.std) AS e FROM a, b""")
def _(t):
    return blocks.value_at(blocks.stack_bins(values(t), "x", "v", "s", 4.0), 17.3, 4.0)


@query("depth_mean_by_zone", keys="line_id zone", ints="x", digits={"mean": 8, "err": 8}, sql=f"""
WITH {VS} SELECT line_id, CASE WHEN rp > 1400 THEN 'near' ELSE 'far' END AS zone, x, sum(v / (s * s)) / sum(1 / (s * s)) AS mean, 1 / sqrt(sum(1 / (s * s))) AS err FROM vs WHERE s > 0 GROUP BY 1, 2, 3""")
def _(t):
    d = values(t).withColumn("zone", F.when(F.col("rp") > 1400, "near").otherwise("far"))
    return blocks.zone_depth_mean(d, ["line_id", "zone", "x"], "v", "s")


@query("region_quality", keys="line_id", ints="n_far n_mid", digits={"v_far": 8, "v_mid": 8, "s_far": 8, "s_mid": 8}, sql=f"""
WITH {VS} SELECT line_id, count(*) FILTER (x >= 40) AS n_far, count(*) FILTER (x > 10 AND x < 30) AS n_mid, avg(v) FILTER (x >= 40) AS v_far, avg(v) FILTER (x > 10 AND x < 30) AS v_mid, avg(s) FILTER (x >= 40) AS s_far,
  avg(s) FILTER (x > 10 AND x < 30) AS s_mid FROM vs GROUP BY 1""")
def _(t):
    return profiles.region_quality(values(t), {"far": F.col("x") >= 40, "mid": (F.col("x") > 10) & (F.col("x") < 30)}, ["line_id"], ["v", "s"])


@query("array_mean_tide", ints="ts", digits={"mean": 6, "spread": 3}, sql="SELECT epoch_us(date_trunc('hour', ts)) AS ts, avg(value) AS mean, max(value) - min(value) AS spread FROM events GROUP BY 1")
def _(t):
    d = I.events(t).select((F.floor(F.col("t") / 3600) * 3600000000).alias("ts"), "value")
    return profiles.array_mean(d, "ts", "value")


# --- matches ----------------------------------------------------------------

NEAR = """m AS (SELECT a.s_suppkey AS id, b.c_custkey AS mid, abs(a.s_acctbal - b.c_acctbal) AS gap, a.s_acctbal / 100 AS va, b.c_acctbal / 100 AS vb, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY round(abs(a.s_acctbal - b.c_acctbal), 4), b.c_acctbal, b.c_custkey) AS k
  FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey WHERE abs(a.s_acctbal - b.c_acctbal) <= 100), mt AS (SELECT * FROM m WHERE k = 1)"""


def _matched(t):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nat"), F.col("s_acctbal").alias("x"))
    b = t.customer.select(F.col("c_custkey").alias("cid"), F.col("c_nationkey").alias("nat"), F.col("c_acctbal").alias("x"))
    return matching.nearest_match(a, b, "x", 100.0, ["nat"], "cid")


@query("nearest_match", ints="id mid", digits={"gap": 4}, sql=f"WITH {NEAR} SELECT id, mid, gap FROM mt")
def _(t):
    return _matched(t).select("id", "gap", F.col("b.cid").alias("mid"))


@query("rms_disagreement", ints="nat n", digits={"rms": 6, "expected": 6, "excess": 6}, sql=f"""
WITH {NEAR} SELECT s_nationkey AS nat, count(*) AS n, sqrt(avg(pow(va - vb, 2))) AS rms, sqrt(avg(va * va / 1e4 + 0.01)) AS expected, sqrt(avg(pow(va - vb, 2))) / sqrt(avg(va * va / 1e4 + 0.01)) AS excess
FROM mt JOIN supplier ON id = s_suppkey GROUP BY 1 HAVING count(*) >= 4""")
def _(t):
    d = _matched(t)
    return matching.rms_disagreement(d, ["nat"], F.col("x") / 100, F.col("b.x") / 100, F.col("x") / 1e4, F.lit(0.1))


@query("worst_disagreement", digits={"worst_duplicate": 6, "worst_other": 6}, sql=f"""
WITH {NEAR}, r AS (SELECT s_nationkey AS nat, sqrt(avg(pow(va - vb, 2))) AS rms FROM mt JOIN supplier ON id = s_suppkey GROUP BY 1 HAVING count(*) >= 4) SELECT max(rms) FILTER (nat % 3 = 0) AS worst_duplicate, max(rms) FILTER (nat % 3 <> 0) AS worst_other FROM r""")
def _(t):
    d = matching.rms_disagreement(_matched(t), ["nat"], F.col("x") / 100, F.col("b.x") / 100, F.col("x") / 1e4, F.lit(0.1))
    return matching.worst_disagreement(d, F.col("nat") % 3 == 0)


@query("method_floor", ints="depth n", digits={"rms": 7}, sql=f"""
WITH {MONTHLY} SELECT a.k % 12 AS depth, count(*) AS n, sqrt(avg(pow(a.v - b.v, 2))) AS rms FROM mo a JOIN mo b ON a.row_key = b.row_key AND b.k = a.k + 12 GROUP BY 1""")
def _(t):
    a = monthly(t)
    b = a.select("row_key", (F.col("k") - 12).alias("k"), F.col("v").alias("w"))
    return matching.method_floor(a.join(b, ["row_key", "k"]).withColumn("depth", F.col("k") % 12), "depth", F.col("v"), F.col("w"))


@query("build_change", ints="line_id n", digits={"median_z": 7, "max_z": 7}, sql="""
WITH g AS (SELECT l_linenumber AS line_id, l_suppkey AS block, l_returnflag AS f, avg(l_extendedprice) / 1e4 AS v, stddev_samp(l_extendedprice) / 1e4 AS s FROM lineitem GROUP BY 1, 2, 3),
z AS (SELECT a.line_id, abs(a.v - b.v) / sqrt(a.s * a.s + b.s * b.s) AS z FROM g a JOIN g b ON a.line_id = b.line_id AND a.block = b.block AND a.f = 'A' AND b.f = 'R') SELECT line_id, count(*) AS n, median(z) AS median_z, max(z) AS max_z FROM z WHERE z IS NOT NULL GROUP BY 1""")
def _(t):
    g = t.lineitem.groupBy(F.col("l_linenumber").alias("line_id"), F.col("l_suppkey").alias("block"), F.col("l_returnflag").alias("f")).agg(
        (F.avg("l_extendedprice") / 1e4).alias("v"), (F.stddev_samp("l_extendedprice") / 1e4).alias("s"))
    return matching.build_change(g.where("f = 'A'"), g.where("f = 'R'"), ["line_id", "block"], ["line_id"], "v", "s")


PLANE = """ca AS (SELECT c_custkey AS id, c_nationkey AS nat, c_acctbal AS x, (c_custkey * 37 % 1000) * 10.0 AS y FROM customer), su AS (SELECT s_suppkey AS sid, s_nationkey AS nat, s_acctbal AS x, (s_suppkey * 53 % 1000) * 10.0 AS y FROM supplier)"""


def plane(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nat"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 37 % 1000) * 10.0).alias("y"))
    b = t.supplier.select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("nat"), F.col("s_acctbal").alias("x"), ((F.col("s_suppkey") * 53 % 1000) * 10.0).alias("y"))
    return a, b


# Two builds of a line: blocks of five quantities, placed by their mean tax, one build per return flag.
BUILDS = """bl AS (SELECT l_suppkey AS line_id, l_returnflag AS f, CAST(l_quantity AS INTEGER) // 5 AS block, avg(l_quantity) * 97.3 AS x, avg(l_tax) * 5003 AS y FROM lineitem GROUP BY 1, 2, 3)"""


def builds(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("line_id"), F.col("l_returnflag").alias("f"), F.floor(F.col("l_quantity") / 5).cast("int").alias("block")).agg(
        (F.avg("l_quantity") * 97.3).alias("x"), (F.avg("l_tax") * 5003).alias("y"))


@query("nearest_match_2d", ints="line_id block other", digits={"gap": 5}, sql=f"""
WITH {BUILDS} SELECT a.line_id, a.block, b.block AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS gap FROM bl a JOIN bl b ON a.line_id = b.line_id AND a.f = 'A' AND b.f = 'R' WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 100
QUALIFY row_number() OVER (PARTITION BY a.line_id, a.block ORDER BY gap, b.block) = 1""")
def _(t):
    d = builds(t)
    return matching.nearest_match_xy(d.where("f = 'A'"), d.where("f = 'R'").withColumnRenamed("block", "other"), 100.0, "block", "other", by=["line_id"])


SITES = "pt AS (SELECT n_name AS site, n_nationkey * 397.0 AS px, (n_nationkey * 211 % 1000) * 9.7 AS py FROM nation)"


@query("site_along_track", keys="site", ints="line_id", digits={"along_m": 3, "off_m": 3}, sql=f"""
WITH {PLANE}, {SITES}, tr AS (SELECT *, id * 10.0 AS al, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(id) OVER w * 10.0 AS ba, lead(x) OVER w AS fx, lead(y) OVER w AS fy, lead(id) OVER w * 10.0 AS fa FROM ca WINDOW w AS (PARTITION BY nat ORDER BY id)),
nv AS (SELECT * FROM pt, tr QUALIFY row_number() OVER (PARTITION BY site, nat ORDER BY sqrt(pow(x - px, 2) + pow(y - py, 2)), id) = 1),
sg AS (SELECT site, nat, px, py, x, y, al, bx AS ox, by_ AS oy, ba AS oa FROM nv UNION ALL SELECT site, nat, px, py, x, y, al, fx, fy, fa FROM nv),
tt AS (SELECT *, greatest(0, least(1, ((px - x) * (ox - x) + (py - y) * (oy - y)) / (pow(ox - x, 2) + pow(oy - y, 2)))) AS t FROM sg WHERE ox IS NOT NULL)
SELECT site, nat AS line_id, al + t * (oa - al) AS along_m, sqrt(pow(x + t * (ox - x) - px, 2) + pow(y + t * (oy - y) - py, 2)) AS off_m FROM tt QUALIFY row_number() OVER (PARTITION BY site ORDER BY off_m, nat) = 1""")
def _(t):
    a, _ = plane(t)
    n = F.col("n_nationkey")
    pts = t.nation.select(F.col("n_name").alias("site"), (n * 397.0).alias("x"), ((n * 211 % 1000) * 9.7).alias("y"))
    tr = a.select(F.col("nat").alias("line_id"), F.col("id").alias("col"), "x", "y", (F.col("id") * 10.0).alias("along_m"))
    return matching.project_on_track(pts, tr)


# A boundary of one vertex per nation, one part per region; it does not grow with the lines.
@query("polyline_crossing", ints="line_id", digits={"along_m": 2, "dist": 5}, sql=f"""
WITH {BUILDS}, tk AS (SELECT line_id, block AS col, avg(x) AS x, avg(y) * 10 AS y FROM bl GROUP BY 1, 2), su AS (SELECT n_regionkey AS part, n_nationkey AS sid, n_nationkey * 201.0 AS x, (n_nationkey * 211 % 100) * 35.0 AS y FROM nation),
sn AS (SELECT part, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM su WINDOW w AS (PARTITION BY part ORDER BY sid)), ln AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS l FROM sn WHERE nx IS NOT NULL),
mm AS (SELECT *, greatest(2, CAST(ceil(l / 20) AS INTEGER)) AS m FROM ln WHERE l > 0 AND l <= 5000), dn AS (SELECT DISTINCT x + CAST(k AS DOUBLE) / (m - 1) * (nx - x) AS gx, y + CAST(k AS DOUBLE) / (m - 1) * (ny - y) AS gy FROM mm, range(251) AS r(k) WHERE k < m),
ds AS (SELECT line_id, col, sqrt(pow(tk.x - gx, 2) + pow(tk.y - gy, 2)) AS dist FROM tk JOIN dn ON gx BETWEEN tk.x - 150 AND tk.x + 150 AND gy BETWEEN tk.y - 150 AND tk.y + 150)
SELECT line_id, col * 10.0 AS along_m, dist FROM ds WHERE dist < 150 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY dist, col) = 1""")
def _(t):
    n = F.col("n_nationkey")
    tr = builds(t).groupBy("line_id", F.col("block").alias("col")).agg(F.avg("x").alias("x"), (F.avg("y") * 10).alias("y")).withColumn("along_m", F.col("col") * 10.0)
    edge = t.nation.select(F.col("n_regionkey").alias("part"), n.alias("seq"), (n * 201.0).alias("x"), ((n * 211 % 100) * 35.0).alias("y"))
    return matching.polyline_crossing(tr, edge)


@query("layer_to_blocks", ints="line_id block n_kept n_in", digits={"thickness": 6, "match_m": 5}, sql="""
WITH p AS (SELECT l_suppkey AS line_id, l_quantity * 40 + l_discount * 301 AS px, l_tax * 503 AS py, l_extendedprice / 100 AS h FROM lineitem),
b AS (SELECT l_suppkey AS line_id, CAST(l_quantity AS INTEGER) // 5 AS block, avg(l_quantity) * 40 AS x, avg(l_tax) * 503 AS y FROM lineitem GROUP BY 1, 2),
md AS (SELECT line_id, median(h) AS med FROM p GROUP BY 1), sd AS (SELECT line_id, any_value(med) AS med, 1.4826 * median(abs(h - med)) AS sd FROM p JOIN md USING (line_id) GROUP BY 1),
pk AS (SELECT p.*, abs(h - med) <= 2 * sd AS ok FROM p JOIN sd USING (line_id)),
nn AS (SELECT a.line_id, a.block, a.x, a.y, (o.x - a.x) / sqrt(pow(o.x - a.x, 2) + pow(o.y - a.y, 2)) AS ux, (o.y - a.y) / sqrt(pow(o.x - a.x, 2) + pow(o.y - a.y, 2)) AS uy FROM b a JOIN b o ON a.line_id = o.line_id AND a.block <> o.block
  QUALIFY row_number() OVER (PARTITION BY a.line_id, a.block ORDER BY sqrt(pow(o.x - a.x, 2) + pow(o.y - a.y, 2)), o.block) = 1),
j AS (SELECT nn.line_id, nn.block, h, ok, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS d, abs((px - x) * ux + (py - y) * uy) <= 100 AND abs((py - y) * ux - (px - x) * uy) <= 15 AS inn FROM nn JOIN pk ON nn.line_id = pk.line_id)
SELECT line_id, block, count(*) FILTER (inn AND ok) AS n_kept, count(*) FILTER (inn) AS n_in, median(h) FILTER (inn AND ok) AS thickness, min(d) AS match_m FROM j GROUP BY 1, 2
HAVING count(*) FILTER (inn) > 0 AND min(d) <= 10 AND count(*) FILTER (inn AND ok) > 0 AND count(*) FILTER (inn AND ok) >= 0.8 * count(*) FILTER (inn)""")
def _(t):
    q = F.col("l_quantity")
    line = F.col("l_suppkey").alias("line_id")
    p = t.lineitem.select(line, (q * 40 + F.col("l_discount") * 301).alias("px"), (F.col("l_tax") * 503).alias("py"), (F.col("l_extendedprice") / 100).alias("h"))
    b = t.lineitem.groupBy(line, F.floor(q / 5).cast("int").alias("block")).agg((F.avg("l_quantity") * 40).alias("x"), (F.avg("l_tax") * 503).alias("y"))
    return matching.layer_to_blocks(b, p, 100.0, max_cross=15.0, max_match=10.0, min_frac=0.8, n_mad=2.0)


@query("coalesce_profile", ints="line_id win", digits={"v": 7}, sql=f"""
WITH {I.TRACKS}, c AS (SELECT line_id, col, avg(v) AS v FROM tracks GROUP BY 1, 2) SELECT line_id, w AS win, avg(v) AS v FROM c, range(5) AS r(w) WHERE abs(col - (8 + 9 * w)) <= 6 GROUP BY 1, 2""")
def _(t):
    c = I.tracks(t).groupBy("line_id", "col").agg(F.avg("v").alias("v"))
    w = c.select("line_id").distinct().withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("x_win", 8.2 + 9 * F.col("win"))
    return matching.window_mean_at(c, w, 6, ["line_id"])


AXIS = PLANE + """, cv AS (SELECT nat, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, covar_samp(x, id) AS ox, covar_samp(y, id) AS oy, avg(x) AS x0, avg(y) AS y0 FROM ca GROUP BY 1),
ax AS (SELECT nat, x0, y0, CASE WHEN cos(a) * ox + sin(a) * oy < 0 THEN -cos(a) ELSE cos(a) END AS ux, CASE WHEN cos(a) * ox + sin(a) * oy < 0 THEN -sin(a) ELSE sin(a) END AS uy FROM (SELECT *, 0.5 * atan2(2 * xy, xx - yy) AS a FROM cv))"""


@query("survey_axis", ints="nat", digits={"ux": 7, "uy": 7, "x0": 4, "y0": 4}, sql=f"WITH {AXIS} SELECT * FROM ax")
def _(t):
    a, _ = plane(t)
    return matching.survey_axis(a, "x", "y", F.col("id"), ["nat"])


@query("survey_rotate", ints="id", digits={"s": 4, "n": 4}, sql=f"WITH {AXIS} SELECT id, (x - x0) * ux + (y - y0) * uy AS s, (y - y0) * ux - (x - x0) * uy AS n FROM ca JOIN ax USING (nat)")
def _(t):
    a, _ = plane(t)
    return matching.rotate(a, matching.survey_axis(a, "x", "y", F.col("id"), ["nat"]), "x", "y", ["nat"])


# --- change points and profiles ---------------------------------------------


@query("change_point", ints="row_key", digits={"contrast": 7, "k": 2}, sql=f"""
WITH {MONTHLY}, a AS (SELECT row_key, k, lead(k) OVER w AS nk, row_number() OVER w AS i, sum(v) OVER w AS s, count(*) OVER (PARTITION BY row_key) AS n, sum(v) OVER (PARTITION BY row_key) AS tot FROM mo WINDOW w AS (PARTITION BY row_key ORDER BY k)),
c AS (SELECT row_key, i, (k + nk) / 2.0 AS pos, s / i - (tot - s) / (n - i) AS contrast FROM a WHERE i BETWEEN 3 AND n - 3), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY contrast DESC, i) = 1)
SELECT row_key, contrast, pos AS k FROM b WHERE contrast >= 0.5""")
def _(t):
    d = monthly(t).withColumnRenamed("k", "pos")
    return profiles.change_point(d, "pos", "v", ["row_key"]).select("row_key", "contrast", F.col("pos").alias("k"))


@query("kernel_profile", ints="row_key k n", digits={"xg": 3, "mean": 7, "err": 7}, sql=f"""
WITH {MONTHLY}, o AS (SELECT * FROM mo WHERE s > 0), e AS (SELECT row_key, min(k) AS x0, max(k) AS x1 FROM o GROUP BY 1), g AS (SELECT e.row_key, i, x0 + 5.0 * i AS xg FROM e, range(40) AS r(i) WHERE x0 + 5.0 * i <= x1),
w AS (SELECT g.row_key, i, xg, v, s, pow(1 - pow(abs(k - xg) / 8, 3), 3) / (s * s) AS w FROM g JOIN o ON g.row_key = o.row_key AND abs(k - xg) < 8)
SELECT row_key, i AS k, count(*) AS n, xg, sum(w * v) / sum(w) AS mean, sqrt(sum(w * w * s * s)) / sum(w) AS err FROM w GROUP BY row_key, i, xg HAVING count(*) >= 6""")
def _(t):
    return profiles.kernel_profile(monthly(t).withColumnRenamed("k", "pos"), "pos", "v", "s", 16.0, 5.0, 6, ["row_key"])


@query("depth_gradient", ints="row_key k", digits={"smooth": 7, "gradient": 7}, sql=f"""
WITH {MONTHLY}, a AS (SELECT row_key, k, avg(v) OVER (PARTITION BY row_key ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM mo)
SELECT row_key, k, smooth, (lead(smooth) OVER w - smooth) / (lead(k) OVER w - k) AS gradient FROM a WINDOW w AS (PARTITION BY row_key ORDER BY k)""")
def _(t):
    return profiles.depth_gradient(monthly(t), "k", "v", ["row_key"])


PROF = "pr AS (SELECT l_suppkey AS row_key, l_quantity AS z, avg(l_extendedprice) / 1e4 - 4 AS dh FROM lineitem GROUP BY 1, 2)"
_READ = lambda z: f"(arg_max(dh, z) FILTER (z <= {z}) + ({z} - max(z) FILTER (z <= {z})) * (arg_min(dh, z) FILTER (z >= {z}) - arg_max(dh, z) FILTER (z <= {z})) / nullif(min(z) FILTER (z >= {z}) - max(z) FILTER (z <= {z}), 0))"
SLICES = [(0.0, 10.5), (10.5, 20.5), (20.5, 30.5), (30.5, 49.5)]
SLICED = PROF + f", rd AS (SELECT row_key, {_READ(10.5)} AS a, {_READ(20.5)} AS b, {_READ(30.5)} AS c, {_READ(49.5)} AS d FROM pr GROUP BY 1), sl AS (SELECT row_key, 0.0 AS top, 10.5 AS bottom, a / 10.5 AS strain FROM rd UNION ALL SELECT row_key, 10.5, 20.5, (b - a) / 10 FROM rd UNION ALL SELECT row_key, 20.5, 30.5, (c - b) / 10 FROM rd UNION ALL SELECT row_key, 30.5, 49.5, (d - c) / 19 FROM rd)"


def _slices(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("row_key"), F.col("l_quantity").alias("z")).agg((F.avg("l_extendedprice") / 1e4 - 4).alias("dh"))
    return profiles.slice_strain(p, "z", "dh", ["row_key"], SLICES)


@query("depth_slice_strain", ints="row_key", digits={"top": 1, "bottom": 1, "strain": 8}, sql=f"WITH {SLICED} SELECT * FROM sl")
def _(t):
    return _slices(t)


@query("sign_change_depth", ints="row_key", digits={"first_change": 3, "last_change": 3}, sql=f"""
WITH {SLICED}, f AS (SELECT row_key, CASE WHEN sign(strain) <> sign(lag(strain) OVER w) THEN ((top + bottom) / 2 + lag((top + bottom) / 2) OVER w) / 2 END AS z FROM sl WINDOW w AS (PARTITION BY row_key ORDER BY top))
SELECT row_key, min(z) AS first_change, max(z) AS last_change FROM f GROUP BY 1 HAVING min(z) IS NOT NULL""")
def _(t):
    return profiles.sign_change(_slices(t).withColumn("mid", (F.col("top") + F.col("bottom")) / 2), ["row_key"], "mid", "strain")


SWEEP = """sw AS (SELECT l_suppkey AS row_key, size, CAST(l_quantity AS INTEGER) // size AS blk, avg(l_extendedprice) / 1e4 - 3.5 AS a, stddev_samp(l_extendedprice) / 1e4 / sqrt(count(*)) AS sd FROM lineitem, (VALUES (5), (10), (25)) v(size) GROUP BY 1, 2, 3),
gr AS (SELECT row_key, size, x, a, sd FROM sw, range(0, 50, 5) AS r(x) WHERE x // size = blk)"""


@query("block_size_sweep", ints="size n", digits={"sign_agree": 7, "shift_sigma": 6, "sig_flip": 7}, sql=f"""
WITH {SWEEP} SELECT g.size, count(*) AS n, avg(CASE WHEN sign(g.a) = sign(r.a) THEN 1.0 ELSE 0 END) AS sign_agree, median(abs(g.a - r.a) / greatest(sqrt(g.sd * g.sd + r.sd * r.sd), 2.220446049250313e-16)) AS shift_sigma,
  avg(CASE WHEN sign(g.a) <> sign(r.a) AND abs(g.a) > g.sd AND abs(r.a) > r.sd THEN 1.0 ELSE 0 END) AS sig_flip FROM gr g JOIN gr r ON g.row_key = r.row_key AND g.x = r.x AND r.size = 10 WHERE g.a IS NOT NULL AND r.a IS NOT NULL GROUP BY 1""")
def _(t):
    sizes = F.explode(F.array(*[F.lit(s) for s in (5, 10, 25)]))
    d = t.lineitem.select(F.col("l_suppkey").alias("row_key"), F.col("l_quantity").cast("int").alias("q"), "l_extendedprice")
    d = d.repartition("row_key").withColumn("size", sizes)                    # rows travel once, not once per size
    d = d.groupBy("row_key", "size", F.floor(F.col("q") / F.col("size")).alias("blk")).agg(
        (F.avg("l_extendedprice") / 1e4 - 3.5).alias("a"), (F.stddev_samp("l_extendedprice") / 1e4 / F.sqrt(F.count(F.lit(1)))).alias("sd"))
    lo = F.col("blk") * F.col("size")
    d = d.where(lo < 50).withColumn(
        "x", F.explode(F.sequence(lo.cast("int"), F.least(lo + F.col("size") - 5, F.lit(45)).cast("int"), F.lit(5))))
    return profiles.block_size_sweep(d, [], "size", 10, ["row_key", "x"])


# --- sort, top-k, union -----------------------------------------------------


@query("top_k", ints="l_suppkey n_rejected", sql="SELECT l_suppkey, count(*) AS n_rejected FROM lineitem WHERE l_discount > 0.09 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    d = t.lineitem.where("l_discount > 0.09").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rejected"))
    return network.top_k(d, "n_rejected", ["l_suppkey"], 5)


@query("argmax_row", ints="l_suppkey a", digits={"f": 2}, sql="""
SELECT l_suppkey, a, f FROM (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS a, max(l_extendedprice) AS f FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY f DESC, a) = 1""")
def _(t):
    d = t.lineitem.groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("a")).agg(F.max("l_extendedprice").alias("f"))
    return coherent.argmax_row(d, ["l_suppkey"], "f", "a")


@query("order_seaward", ints="c_custkey rank", sql="SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank FROM customer")
def _(t):
    return ordered(t.customer, "c_nationkey", ["c_acctbal", "c_custkey"], [Scan("rank", F.lit(1).cast("long"), "sum")])


@query("union_lines", keys="src", ints="line_id n", digits={"v": 7}, sql="""
SELECT 'a' AS src, l_suppkey AS line_id, count(*) AS n, avg(l_tax) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 2 UNION ALL SELECT 'r', l_suppkey, count(*), avg(l_tax) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2""")
def _(t):
    line = lambda flag, name: t.lineitem.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("line_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("v")).withColumn("src", F.lit(name))
    return line("A", "a").unionByName(line("R", "r"))


# --- modulus ----------------------------------------------------------------

E_GRID, X0_GRID = flexure.log_grid(0.2e9, 20e9, 9), [-1000.0 + 750 * k for k in range(5)]


def flex_obs(t):
    """Quantity as distance, the rise of the price along it as the response. Ship lines are exchanged by line, once for all that follows."""
    kind = F.when(F.col("l_returnflag") == "R", "strain").otherwise("shape")
    x = (F.col("l_quantity") * 200).cast("double")
    d = t.lineitem.select(F.col("l_suppkey").alias("line_id"), kind.alias("kind"), x.alias("x"), "l_extendedprice").repartition("line_id")
    d = d.groupBy("line_id", "kind", "x").agg(
        (F.avg("l_extendedprice") / 1e5).alias("y"), (F.coalesce(F.stddev_samp("l_extendedprice") / 1e5, F.lit(0.3)) + 0.05).alias("sigma"))
    return d.withColumn("width", F.lit(200.0)).withColumn("y", F.when(F.col("kind") == "strain", F.col("y") * 1e-3).otherwise(F.col("y"))).withColumn(
        "sigma", F.when(F.col("kind") == "strain", F.col("sigma") * 1e-3).otherwise(F.col("sigma")))


FLEX = """fo AS (SELECT line_id, kind, x, y * f AS y, sg * f AS sigma FROM (SELECT l_suppkey AS line_id, CASE WHEN l_returnflag = 'R' THEN 'strain' ELSE 'shape' END AS kind, l_quantity * 200 AS x, avg(l_extendedprice) / 1e5 AS y,
  coalesce(stddev_samp(l_extendedprice) / 1e5, 0.3) + 0.05 AS sg, CASE WHEN any_value(l_returnflag) = 'R' THEN 1e-3 ELSE 1.0 END AS f FROM lineitem GROUP BY 1, 2, 3)),
cd AS (SELECT i AS ie, pow(10, log10(2e8) + 2.0 * i / 8) AS E, j AS ix, -1000.0 + 750 * j AS x0, pow(4 * pow(10, log10(2e8) + 2.0 * i / 8) * pow(280, 3) / (12 * 0.91) / (1028 * 9.81), 0.25) AS lam FROM range(9) AS r(i), range(5) AS s(j)),
bt AS (SELECT line_id, kind, x, y, sigma, ie, E, ix, x0, greatest(x - x0, 0) / lam AS b, lam FROM fo, cd),
pd AS (SELECT *, CASE WHEN kind = 'shape' THEN 1 - exp(-b) * (cos(b) + sin(b)) ELSE 0.3 / 0.7 * (140.0 * 100 - 5000) * 2 / (lam * lam) * exp(-b) * (cos(b) - sin(b)) END AS pred, 1 / (sigma * sigma) AS u FROM bt),
js AS (SELECT line_id, ie, E, ix, x0, count(*) AS n, sum(u * pred * y) / sum(u * pred * pred) AS amp, sum(u * y * y) - pow(sum(u * pred * y), 2) / sum(u * pred * pred) AS J FROM pd GROUP BY 1, 2, 3, 4, 5),
pf AS (SELECT * FROM js QUALIFY row_number() OVER (PARTITION BY line_id, ie ORDER BY J, ix) = 1),
pm AS (SELECT *, min(J) OVER (PARTITION BY line_id) AS J_min, greatest(min(J) OVER (PARTITION BY line_id) / (n - 3), 1) AS s2 FROM pf)"""


def analytic_predictions(t):
    return analytic(flexure.candidate_grid(flex_obs(t).drop("width"), E_GRID, X0_GRID))


def analytic(c):
    """Deflection and bending of the semi-infinite beam at every observation and candidate."""
    lam = F.sqrt(F.sqrt(4 * F.col("E") * 280.0 ** 3 / (12 * 0.91) / (1028 * 9.81)))
    b = F.greatest(F.col("x") - F.col("x0"), F.lit(0.0)) / lam
    w = 1 - F.exp(-b) * (F.cos(b) + F.sin(b))
    k = (0.3 / 0.7) * (140.0 * 100 - 5000) * 2 / (lam * lam) * F.exp(-b) * (F.cos(b) - F.sin(b))
    return c.withColumn("pred", F.when(F.col("kind") == "shape", w).otherwise(k))


def _profile(t):
    return flexure.profile_misfit(flexure.candidate_misfit(analytic_predictions(t), None, ["line_id"]), ["line_id"])


@query("misfit_profile", ints="line_id ie n", digits={"x0": 2, "amp": 6, "J": 5, "s2": 7}, sql=f"WITH {FLEX} SELECT line_id, ie, n, x0, amp, J, s2 FROM pm")
def _(t):
    return _profile(t)


INTERVAL = FLEX + """, nb AS (SELECT *, log10(E) AS u, lag(J) OVER w AS pj, lead(J) OVER w AS nj, lag(log10(E)) OVER w AS pu, lead(log10(E)) OVER w AS nu, first_value(ie) OVER (PARTITION BY line_id ORDER BY J, ie) AS eb, J_min + s2 AS thr FROM pm WINDOW w AS (PARTITION BY line_id ORDER BY ie)),
bb AS (SELECT *, ((nj - J) / (nu - u) - (J - pj) / (u - pu)) / (nu - pu) AS curv FROM nb WHERE ie = eb), hf AS (SELECT *, CASE WHEN curv > 0 THEN sqrt(s2 / curv) END AS half FROM bb),
dn AS (SELECT line_id, arg_max(pow(10, nu + greatest(0, least(1, (thr - nj) / (J - nj))) * (u - nu)), ie) AS e FROM nb WHERE ie < eb AND J >= thr GROUP BY 1), up AS (SELECT line_id, arg_min(pow(10, pu + greatest(0, least(1, (thr - pj) / (J - pj))) * (u - pu)), ie) AS e FROM nb WHERE ie > eb AND J >= thr GROUP BY 1),
wl AS (SELECT a.line_id, a.ie, max(c.J) AS wall FROM nb a JOIN nb c ON a.line_id = c.line_id AND c.ie BETWEEN least(a.ie, a.eb) AND greatest(a.ie, a.eb) GROUP BY 1, 2),
rv AS (SELECT line_id, count(*) AS k FROM nb JOIN wl USING (line_id, ie) WHERE ie <> eb AND J < pj AND J < nj AND wall - J > s2 AND J - J_min < 9 * s2 GROUP BY 1),
mi AS (SELECT h.line_id, h.n, coalesce(k, 0) + 1 AS n_min, h.E, CASE WHEN coalesce(half <= 0.25, false) THEN pow(10, u - half) WHEN dn.e IS NOT NULL THEN least(dn.e, h.E) END AS E_lo,
  CASE WHEN coalesce(half <= 0.25, false) THEN pow(10, u + half) WHEN up.e IS NOT NULL THEN greatest(up.e, h.E) END AS E_hi, x0, pj IS NOT NULL AND nj IS NOT NULL AND x0 > -1000 AND x0 < 2000 AS interior
  FROM hf h LEFT JOIN dn USING (line_id) LEFT JOIN up USING (line_id) LEFT JOIN rv USING (line_id))"""


@query("modulus_interval", keys="interior", ints="line_id n n_min", digits={"E": -2, "E_lo": -4, "E_hi": -4, "x0": 2}, sql=f"WITH {INTERVAL} SELECT * FROM mi")
def _(t):
    return flexure.modulus_interval(_profile(t), ["line_id"])


@query("combine_profiles", ints="n_lines", digits={"E": -2, "E_lo": -4, "E_hi": -4}, sql=f"""
WITH {FLEX}, sm AS (SELECT ie, any_value(E) AS E, log10(any_value(E)) AS u, sum((J - J_min) / s2) AS J, count(*) AS n FROM pm GROUP BY 1), b AS (SELECT * FROM sm ORDER BY J, ie LIMIT 1), nb AS (SELECT *, lag(J) OVER w AS pj, lead(J) OVER w AS nj, lag(u) OVER w AS pu, lead(u) OVER w AS nu FROM sm WINDOW w AS (ORDER BY ie)),
lo AS (SELECT pow(10, nu + (b.J + 1 - nj) / (nb.J - nj) * (nb.u - nu)) AS E FROM nb, b WHERE nb.ie < b.ie AND nb.J > b.J + 1 ORDER BY nb.ie DESC LIMIT 1), hi AS (SELECT pow(10, pu + (b.J + 1 - pj) / (nb.J - pj) * (nb.u - pu)) AS E FROM nb, b WHERE nb.ie > b.ie AND nb.J > b.J + 1 ORDER BY nb.ie LIMIT 1)
SELECT b.E, (SELECT E FROM lo) AS E_lo, (SELECT E FROM hi) AS E_hi, b.n AS n_lines FROM b""")
def _(t):
    return flexure.combine_profiles(_profile(t), "line_id")


@query("modulus_jackknife", ints="grp n", digits={"se_decades": 6}, sql=f"""
WITH {INTERVAL} SELECT line_id % 5 AS grp, count(*) AS n, sqrt((count(*) - 1) * var_pop(log10(E))) AS se_decades FROM mi WHERE E_lo IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    # Here a fit counts as interior where its lower bound is closed.
    fits = flexure.modulus_interval(_profile(t), ["line_id"]).withColumn("grp", F.col("line_id") % 5).withColumn("interior", F.col("E_lo").isNotNull())
    return flexure.modulus_jackknife(fits, ["grp"])


@query("modulus_fit", keys="interior", ints="line_id n", digits={"E": -5, "E_fine": -5, "x0_fine": 1, "amp": 5})
def _(t):
    return chains.modulus(flex_obs(t).drop("width"), analytic, flexure.log_grid(0.2e9, 20e9, 41), [-1000.0 + 250 * k for k in range(17)])[0]


@query("modulus_reweighted", keys="kind", ints="line_id", digits={"factor": 5})
def _(t):
    _, factors = flexure.reweighted_fit(analytic_predictions(t), None, ["line_id"], max_rounds=2)
    return factors
