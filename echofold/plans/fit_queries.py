"""Networks, regressions, coherent scans and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.functions import columns as C
from echofold.functions.stats import student_t_p
from echofold.operators import coherent, firn, interp, network, pairs, profiles, regress
from echofold.params import FirnParams
from echofold.plans import chains
from echofold.plans import inputs as I
from echofold.plans.pair_queries import FIRN_CTE, STATION_PAIRS, _interp, station_pairs
from echofold.plans.registry import query

# --- pair networks ----------------------------------------------------------

YEARLY_BRAND = """yb AS (SELECT p_brand AS row_key, CAST(year(l_shipdate) - 1994 AS INTEGER) AS ep, avg(l_extendedprice) / 1e4 AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def yearly_brand(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("row_key"), I.year_pass().alias("pass_idx")).agg((F.avg("l_extendedprice") / 1e4).alias("v"))


def complete_pairs(t):
    p = pairs.pair_samples(yearly_brand(t), key=["row_key"], values=["v"])
    return p.select("row_key", "ref_idx", "sec_idx", (F.col("sec_v") - F.col("ref_v")).alias("d"))


@query("network_epochs", keys="row_key", ints="epoch", digits={"x": 7}, sql=f"""
WITH {YEARLY_BRAND} SELECT b.row_key, b.ep AS epoch, avg(b.v - a.v) AS x FROM yb a JOIN yb b ON a.row_key = b.row_key GROUP BY 1, 2""")
def _(t):
    ep, _ = network.invert_network(complete_pairs(t), ["row_key"], "ref_idx", "sec_idx", "d")
    return ep


@query("network_complete", keys="row_key", ints="epoch", digits={"x": 7}, sql=f"""
WITH {I.PAIRDIFF}, bth AS (SELECT row_key, sec_idx AS epoch, d FROM pairdiff UNION ALL SELECT row_key, ref_idx, -d FROM pairdiff),
m AS (SELECT row_key, max(sec_idx) - min(ref_idx) + 1 AS n FROM pairdiff GROUP BY 1)
SELECT row_key, epoch, sum(d) / any_value(n) AS x FROM bth JOIN m USING (row_key) GROUP BY 1, 2""")
def _(t):
    return network.complete_network(I.pairdiff(t), ["row_key"], "ref_idx", "sec_idx", "d")


def _balance(src: str, o: str) -> str:
    """One least-squares solution of every network of `src` (row_key, i, j, d, w), over epochs 1 to 7.

    The normal equations of the largest component, with a row of ones that holds its mean at zero, the right side
    and the identity beside them, are cleared column by column. `o`_x: epochs; `o`_r: pairs with residuals.
    """
    return f"""{o}_u AS (SELECT row_key, i AS a, j AS b FROM {src} UNION SELECT row_key, j, i FROM {src}),
{o}_v AS (SELECT row_key, a, a AS b FROM {o}_u UNION SELECT v.row_key, v.a, u.b FROM {o}_v v JOIN {o}_u u ON u.row_key = v.row_key AND u.a = v.b),
{o}_b AS (SELECT row_key, a, count(*) AS m FROM {o}_v GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY count(*) DESC, a) = 1),
{o}_n AS (SELECT row_key, b AS node, m FROM {o}_v JOIN {o}_b USING (row_key, a)),
{o}_p AS (SELECT p.*, n.node IS NOT NULL AS part FROM {src} p LEFT JOIN {o}_n n ON n.row_key = p.row_key AND n.node = p.i),
{o}_l AS (SELECT row_key, i AS r, i AS c, w, -w * d AS f FROM {o}_p WHERE part UNION ALL SELECT row_key, j, j, w, w * d FROM {o}_p WHERE part
  UNION ALL SELECT row_key, i, j, -w, 0 FROM {o}_p WHERE part UNION ALL SELECT row_key, j, i, -w, 0 FROM {o}_p WHERE part),
{o}_g AS (SELECT row_key, r, c, sum(w) AS g FROM {o}_l GROUP BY 1, 2, 3), {o}_f AS (SELECT row_key, r, sum(f) AS f FROM {o}_l GROUP BY 1, 2),
{o}_a AS (SELECT k.row_key, r.q AS r, list(CAST(CASE WHEN x.node IS NOT NULL AND y.node IS NOT NULL THEN coalesce(g, 0) + 1 WHEN r.q = c.q THEN 1 ELSE 0 END AS DOUBLE) ORDER BY c.q) AS body
  FROM {o}_b k CROSS JOIN range(1, 8) r(q) CROSS JOIN range(1, 8) c(q) LEFT JOIN {o}_n x ON x.row_key = k.row_key AND x.node = r.q
  LEFT JOIN {o}_n y ON y.row_key = k.row_key AND y.node = c.q LEFT JOIN {o}_g g ON g.row_key = k.row_key AND g.r = r.q AND g.c = c.q GROUP BY 1, 2),
{o}_e AS (SELECT a.row_key, a.r, 1 AS k, list_concat(body, [coalesce(f, 0)], list_transform(range(1, 8), lambda q: CASE WHEN q = a.r THEN 1.0::DOUBLE ELSE 0 END)) AS c
    FROM {o}_a a LEFT JOIN {o}_f f ON f.row_key = a.row_key AND f.r = a.r
  UNION ALL SELECT row_key, r, k + 1, list_transform(range(1, 16), lambda q: CASE WHEN r = k THEN c[q] / p[k] ELSE c[q] - c[k] / p[k] * p[q] END)
    FROM (SELECT *, max(CASE WHEN r = k THEN c END) OVER (PARTITION BY row_key) AS p FROM {o}_e WHERE k <= 7)),
{o}_x AS (SELECT e.row_key, node, m, c[8] AS x, c[8 + node] AS spread FROM {o}_e e JOIN {o}_n n ON n.row_key = e.row_key AND n.node = e.r WHERE k = 8),
{o}_r AS (SELECT p.*, CASE WHEN part THEN b.x - a.x - d END AS resid FROM {o}_p p LEFT JOIN {o}_x a ON a.row_key = p.row_key AND a.node = p.i LEFT JOIN {o}_x b ON b.row_key = p.row_key AND b.node = p.j)"""


def _gate(o: str, out: str) -> str:
    """The pairs of a solution within two scaled MADs, of networks that still have six."""
    return f"""{out}_m AS (SELECT *, median(resid) OVER (PARTITION BY row_key) AS mid FROM {o}_r WHERE part),
{out}_s AS (SELECT *, 1.4826 * median(abs(resid - mid)) OVER (PARTITION BY row_key) AS s FROM {out}_m),
{out} AS (SELECT row_key, i, j, d, w, top FROM {out}_s WHERE NOT (s > 1e-12 * top AND abs(resid) > 2 * s) QUALIFY count(*) OVER (PARTITION BY row_key) >= 6)"""


NETWORK = f"""WITH RECURSIVE {I.PAIRDIFF}, p0 AS (SELECT row_key, ref_idx AS i, sec_idx AS j, d, n AS w, max(abs(d)) OVER (PARTITION BY row_key) AS top FROM pairdiff QUALIFY count(*) OVER (PARTITION BY row_key) >= 6),
{", ".join(f"{_balance(f'p{k}', f's{k}')}, {_gate(f's{k}', f'p{k + 1}')}" for k in range(4))}, {_balance("p4", "fin")},
sq AS (SELECT row_key, count(*) AS n_used, sqrt(avg(resid * resid)) AS rms, sum(w * resid * resid) AS wss FROM fin_r WHERE part GROUP BY 1 HAVING count(*) >= 6),
pr AS (SELECT p0.row_key, p0.i AS ref_idx, p0.j AS sec_idx, f.resid, coalesce(f.part, FALSE) AS used FROM p0 JOIN sq USING (row_key) LEFT JOIN fin_r f ON f.row_key = p0.row_key AND f.i = p0.i AND f.j = p0.j)"""


@query("invert_network", keys="row_key", ints="epoch n_used n_epoch", digits={"x": 8, "x_std": 8, "rms": 8}, sql=NETWORK + """
SELECT row_key, node AS epoch, x, sqrt(abs(wss / greatest(1, n_used - (m - 1)) * spread)) AS x_std, n_used, m AS n_epoch, rms FROM fin_x JOIN sq USING (row_key)""")
def _(t):
    ep, _ = network.invert_network(I.pairdiff(t), ["row_key"], "ref_idx", "sec_idx", "d", "n", n_sigma=2.0)
    return ep


@query("network_residuals", keys="row_key used", ints="ref_idx sec_idx", digits={"resid": 8}, sql=NETWORK + " SELECT * FROM pr")
def _(t):
    _, pr = network.invert_network(I.pairdiff(t), ["row_key"], "ref_idx", "sec_idx", "d", "n", n_sigma=2.0)
    return pr


@query("rejected_pairs", ints="ref_idx sec_idx n_rejected", sql=NETWORK + """
SELECT ref_idx, sec_idx, count(*) AS n_rejected FROM pr WHERE NOT used GROUP BY 1, 2 ORDER BY n_rejected DESC, ref_idx, sec_idx LIMIT 5""")
def _(t):
    _, pr = network.invert_network(I.pairdiff(t), ["row_key"], "ref_idx", "sec_idx", "d", "n", n_sigma=2.0)
    return network.rejected_pairs(pr, "ref_idx", "sec_idx", [], 5)


EDGES = """e AS (SELECT a.l_linenumber AS g, CAST(a.l_quantity AS INTEGER) AS i, CAST(b.l_quantity AS INTEGER) AS j
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_discount = 0.07 AND a.l_tax = 0.05 AND b.l_tax < 0.02)"""


def edges(t):
    a = t.lineitem.where("l_discount = 0.07 and l_tax = 0.05").select("l_orderkey", F.col("l_linenumber").alias("g"), F.col("l_quantity").cast("int").alias("i"))
    b = t.lineitem.where("l_tax < 0.02").select("l_orderkey", (F.col("l_linenumber") - 1).alias("g"), F.col("l_quantity").cast("int").alias("j"))
    return a.join(b, ["l_orderkey", "g"]).select("g", "i", "j")


@query("largest_component", ints="g node", sql=f"""
WITH RECURSIVE {EDGES}, u AS (SELECT DISTINCT g, i AS a, j AS b FROM e WHERE i <> j UNION SELECT DISTINCT g, j, i FROM e WHERE i <> j),
r AS (SELECT g, a AS node, a AS seen FROM u UNION SELECT r.g, r.node, u.b FROM r JOIN u ON u.g = r.g AND u.a = r.seen),
l AS (SELECT g, node, min(seen) AS label FROM r GROUP BY 1, 2), s AS (SELECT g, label, count(*) AS n FROM l GROUP BY 1, 2),
b AS (SELECT g, label FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, label) = 1)
SELECT l.g, l.node FROM l JOIN b ON l.g = b.g AND l.label = b.label""")
def _(t):
    return network.largest_component(edges(t), "i", "j", ["g"])


STEPS = I.PAIRDIFF.replace("pairdiff AS", "pd AS") + """, keys AS (SELECT DISTINCT row_key FROM pd WHERE sec_idx = ref_idx + 1),
step AS (SELECT a.row_key, a.k, CASE WHEN n >= 3 THEN d END AS step FROM (SELECT row_key, k FROM keys, range(1, 7) AS r(k)) a LEFT JOIN pd ON pd.row_key = a.row_key AND ref_idx = a.k AND sec_idx = a.k + 1),
chain AS (SELECT row_key, k + 1 AS pass_idx, sum(step) OVER w AS chained, sum(CASE WHEN step IS NULL THEN 1 ELSE 0 END) OVER w AS gaps FROM step WHERE k >= 3 WINDOW w AS (PARTITION BY row_key ORDER BY k)
  UNION ALL SELECT row_key, k, -sum(step) OVER w, sum(CASE WHEN step IS NULL THEN 1 ELSE 0 END) OVER w FROM step WHERE k < 3 WINDOW w AS (PARTITION BY row_key ORDER BY k DESC)
  UNION ALL SELECT DISTINCT row_key, 3, 0, 0 FROM step)"""


def _chain(t):
    p = I.pairdiff(t)
    steps = p.where("sec_idx = ref_idx + 1").select("row_key", F.col("ref_idx").alias("k"), F.when(F.col("n") >= 3, F.col("d")).alias("step"))
    ref = p.select("row_key").distinct().withColumn("ref_idx", F.lit(3))
    return p, network.chain_from_reference(steps, ref, ["row_key"])


@query("chain_from_reference", keys="row_key", ints="pass_idx", digits={"chained": 8}, sql=f"WITH {STEPS} SELECT row_key, pass_idx, chained FROM chain WHERE gaps = 0")
def _(t):
    return _chain(t)[1]


@query("loop_closure", keys="row_key", ints="n", digits={"mean": 7, "rms": 7, "worst": 7, "r_abs_dt": 6, "slope": 7}, sql=f"""
WITH {STEPS}, dir AS (SELECT row_key, sec_idx AS pass_idx, 1.01 * d AS value, sec_idx - 3.2 AS dt FROM pd WHERE ref_idx = 3 UNION ALL SELECT row_key, ref_idx, -1.01 * d, ref_idx - 3.2 FROM pd WHERE sec_idx = 3),
c AS (SELECT row_key, value - chained AS c, dt FROM dir JOIN (SELECT * FROM chain WHERE gaps = 0) USING (row_key, pass_idx))
SELECT row_key, count(*) AS n, avg(c) AS mean, sqrt(avg(c * c)) AS rms, max(abs(c)) AS worst, corr(abs(dt), c) AS r_abs_dt, regr_slope(c, dt) AS slope FROM c WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 4""")
def _(t):
    # The direct values carry a gain of 1 %, so that there is something to close even where the pairs agree.
    p, ch = _chain(t)
    p = p.withColumn("d", 1.01 * F.col("d"))
    fwd = p.where("ref_idx = 3").select("row_key", F.col("sec_idx").alias("pass_idx"), F.col("d").alias("value"), (F.col("sec_idx") - 3.2).alias("dt"))
    back = p.where("sec_idx = 3").select("row_key", F.col("ref_idx").alias("pass_idx"), (-F.col("d")).alias("value"), (F.col("ref_idx") - 3.2).alias("dt"))
    return network.loop_closure(fwd.unionByName(back), ch, ["row_key"])


# --- trend and driver -------------------------------------------------------

SERIES = "s AS (SELECT l_suppkey AS block, l_extendedprice / 1e4 AS y, (epoch_us(l_shipdate) / 8.64e10 - 9131) / 1000 AS t, l_quantity / 10 AS h, l_discount * 10 AS q FROM lineitem)"
FIT = SERIES + """, m AS (SELECT block, count(*) AS n, avg(y) AS my, avg(t) AS mt, avg(h) AS mh, var_pop(t) * count(*) AS tt, var_pop(h) * count(*) AS hh, covar_pop(t, h) * count(*) AS th,
  covar_pop(t, y) * count(*) AS ty, covar_pop(h, y) * count(*) AS hy, var_pop(y) * count(*) AS yy FROM s GROUP BY 1),
f AS (SELECT *, (ty * hh - hy * th) / (tt * hh - th * th) AS b, (hy * tt - ty * th) / (tt * hh - th * th) AS c, n - 3 AS dof FROM m),
g AS (SELECT *, yy - b * ty - c * hy AS sse FROM f),
fit AS (SELECT *, sqrt(sse / dof * hh / (tt * hh - th * th)) AS sd_b, sqrt(sse / dof * tt / (tt * hh - th * th)) AS sd_c FROM g)"""


def block_series(t):
    return t.lineitem.select(F.col("l_suppkey").alias("block"), (F.col("l_extendedprice") / 1e4).alias("y"),
                             ((C.epoch_us("l_shipdate") / 8.64e10 - 9131) / 1000).alias("t"), (F.col("l_quantity") / 10).alias("h"), (F.col("l_discount") * 10).alias("q"))


@query("trend_and_driver", ints="block n dof", digits={"intercept": 6, "trend": 6, "driver": 6, "trend_std": 6, "driver_std": 6, "r_th": 6, "r_partial": 6}, sql=f"""
WITH {FIT} SELECT block, n, dof, my AS intercept, b AS trend, c AS driver, sd_b AS trend_std, sd_c AS driver_std, th / sqrt(tt * hh) AS r_th,
  (c / sd_c) / sqrt((c / sd_c) * (c / sd_c) + dof) AS r_partial FROM fit""")
def _(t):
    return regress.fit_trend_and_driver(block_series(t), "y", "t", "h", ["block"], p_value=False)


@query("student_t_p", ints="block", digits={"p": 5}, sql=f"""
WITH {FIT}, th AS (SELECT block, dof, atan(abs(b / sd_b) / sqrt(dof)) AS lim FROM fit),
simpson AS (SELECT block, any_value(dof) AS dof, sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(lim * i / 2000.0), dof - 1)) * any_value(lim) / 6000.0 AS area
  FROM th, range(2001) AS r(i) GROUP BY block)
SELECT block, 1 - 2 * area * exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) / sqrt(pi()) AS p FROM simpson""")
def _(t):
    f = regress.fit_trend_and_driver(block_series(t), "y", "t", "h", ["block"], p_value=False)
    return f.select("block", student_t_p(F.col("trend") / F.col("trend_std"), F.col("dof").cast("double")).alias("p"))


@query("epoch_residuals", ints="block", digits={"resid": 6}, sql=f"""
WITH {FIT} SELECT s.block, sqrt(avg(pow(s.y - fit.my - b * (s.t - mt) - c * (s.h - mh), 2))) AS resid FROM s JOIN fit ON s.block = fit.block GROUP BY 1""")
def _(t):
    r = regress.trend_residuals(block_series(t), "y", "t", "h", ["block"])
    return regress.residual_rms_by_pass(r, [], "block").withColumnRenamed("rms", "resid")


@query("phase_lag_test", ints="block n", digits={"sd_in_phase": 6, "sd_with_lag": 6}, sql=f"""
WITH {FIT}, e AS (SELECT s.block, s.y - fit.my - b * (s.t - mt) - c * (s.h - mh) AS ey, s.q, s.t - mt AS t0, s.h - mh AS h0 FROM s JOIN fit ON s.block = fit.block),
mq AS (SELECT block, covar_pop(t0, q) * count(*) AS tq, covar_pop(h0, q) * count(*) AS hq, avg(q) AS mq FROM e GROUP BY 1),
eq AS (SELECT e.block, e.ey, e.q - mq.mq - e.t0 * (tq * hh - hq * th) / (tt * hh - th * th) - e.h0 * (hq * tt - tq * th) / (tt * hh - th * th) AS q1 FROM e JOIN mq ON e.block = mq.block JOIN fit ON e.block = fit.block)
SELECT block, count(*) AS n, stddev_samp(ey) AS sd_in_phase, sqrt((sum(ey * ey) - pow(sum(ey * q1), 2) / sum(q1 * q1)) / (count(*) - 1)) AS sd_with_lag FROM eq GROUP BY 1""")
def _(t):
    return regress.phase_lag_test(block_series(t), "y", "t", "h", "q", ["block"])


# Blocks of a line are the seven line numbers, passes are quarters; t and h are those of the quarter.
QUARTERS = """qv AS (SELECT l_linenumber AS block, p_brand AS line_id, year(l_shipdate) * 4 + quarter(l_shipdate) AS pass_idx, avg(l_extendedprice) / 1e4 AS y
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
qt AS (SELECT year(l_shipdate) * 4 + quarter(l_shipdate) AS pass_idx, (year(l_shipdate) * 4 + quarter(l_shipdate) - 7980) / 4.0 AS t, avg(l_discount) * 1000 AS h FROM lineitem GROUP BY 1, 2),
q AS (SELECT qv.*, t, h FROM qv JOIN qt USING (pass_idx)),
qm AS (SELECT line_id, block, avg(y) AS my, avg(t) AS mt, avg(h) AS mh, var_pop(t) AS tt, var_pop(h) AS hh, covar_pop(t, h) AS th, covar_pop(t, y) AS ty, covar_pop(h, y) AS hy FROM q GROUP BY 1, 2 HAVING count(*) >= 6),
qr AS (SELECT q.line_id, q.block, q.pass_idx, y - my - (ty * hh - hy * th) / (tt * hh - th * th) * (t - mt) - (hy * tt - ty * th) / (tt * hh - th * th) * (h - mh) AS resid FROM q JOIN qm USING (line_id, block)),
rr AS (SELECT a.line_id, corr(a.resid, b.resid) AS rho FROM qr a JOIN qr b ON a.line_id = b.line_id AND a.pass_idx = b.pass_idx AND a.block < b.block GROUP BY a.line_id, a.block, b.block HAVING count(*) >= 6)"""


def quarters(t):
    q = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    v = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_linenumber").alias("block"), F.col("p_brand").alias("line_id"), q.alias("pass_idx")).agg((F.avg("l_extendedprice") / 1e4).alias("y"))
    d = t.lineitem.groupBy(q.alias("pass_idx")).agg((F.avg("l_discount") * 1000).alias("h")).withColumn("t", (F.col("pass_idx") - 7980) / 4)
    return v.join(d, "pass_idx")


@query("repeatable_residual", keys="line_id", ints="n_pairs", digits={"rho": 7}, sql=f"WITH {QUARTERS} SELECT line_id, count(*) AS n_pairs, median(rho) AS rho FROM rr GROUP BY 1")
def _(t):
    r = regress.trend_residuals(quarters(t), "y", "t", "h", ["line_id", "block"], keep=["pass_idx"])
    return regress.repeatable_residual(r, ["line_id"], "block", "pass_idx")


@query("residual_budget", keys="line_id", digits={"closure": 5, "per_pass": 5, "model": 5, "total": 5, "unexplained": 5}, sql=f"""
WITH {QUARTERS}, net AS (SELECT line_id, block, sqrt(avg(resid * resid)) / 3 AS rms FROM qr GROUP BY 1, 2), c AS (SELECT line_id, median(rms) * 1e5 AS closure FROM net GROUP BY 1),
sd AS (SELECT line_id, block, stddev_samp(resid) AS s FROM qr GROUP BY 1, 2), tt AS (SELECT line_id, median(s) * 1e5 AS total FROM sd GROUP BY 1), rh AS (SELECT line_id, median(rho) AS rho FROM rr GROUP BY 1)
SELECT line_id, closure, total * sqrt(greatest(rho, 0)) AS per_pass, 0.05 * total AS model, total,
  sqrt(greatest(total * total - closure * closure - total * total * greatest(rho, 0) - 0.0025 * total * total, 0)) AS unexplained FROM c JOIN tt USING (line_id) JOIN rh USING (line_id)""")
def _(t):
    r = regress.trend_residuals(quarters(t), "y", "t", "h", ["line_id", "block"], keep=["pass_idx"])
    rho = regress.repeatable_residual(r, ["line_id"], "block", "pass_idx")
    net = r.groupBy("line_id", "block").agg((F.sqrt(F.avg(F.col("resid") * F.col("resid"))) / 3).alias("rms"))
    return profiles.residual_budget(net, r, rho, ["line_id"], "block")


@query("rate_regression", keys="event_type", ints="n", digits={"slope": 6, "se": 6, "r2": 7}, sql=f"""
WITH {I.EVENTS} SELECT event_type, count(*) AS n, regr_slope(value, x) AS slope, sqrt((regr_syy(value, x) - regr_slope(value, x) * regr_sxy(value, x)) / (count(*) - 2) / regr_sxx(value, x)) AS se, regr_r2(value, x) AS r2
FROM (SELECT event_type, value, (t - 1704067200) / 86400 AS x FROM ev) GROUP BY 1""")
def _(t):
    return regress.rate_regression(I.events(t).withColumn("x", (F.col("t") - 1704067200) / 86400), "x", "value", ["event_type"])


SITE_TIDE = "st AS (SELECT CAST(user_id % 7 AS VARCHAR) AS site, t AS ts_s, avg(value) AS tide_m FROM ev WHERE event_type = 'view' GROUP BY 1, 2)"


def site_tide(t):
    return I.series(t, "view").groupBy((F.col("user_id") % 7).cast("string").alias("site"), F.col("t").alias("ts_s")).agg(F.avg("value").alias("tide_m"))


FRACTION = f"""{I.EVENTS}, {SITE_TIDE}, {STATION_PAIRS}, tn AS (SELECT *, lead(ts_s) OVER w AS x1, lead(tide_m) OVER w AS v1, row_number() OVER w AS rn FROM st WINDOW w AS (PARTITION BY site ORDER BY ts_s)),
k AS (SELECT p.site, CASE WHEN t.ts_s IS NULL THEN h.tide_m WHEN t.x1 IS NULL OR t.ts_s = p.t1_s THEN t.tide_m ELSE t.tide_m + (p.t1_s - t.ts_s) * (t.v1 - t.tide_m) / (t.x1 - t.ts_s) END AS v
  FROM (SELECT * FROM spairs) p ASOF LEFT JOIN tn t ON p.site = t.site AND p.t1_s >= t.ts_s LEFT JOIN (SELECT * FROM tn WHERE rn = 1) h ON p.site = h.site),
fr AS (SELECT k.site, (max(v) - min(v)) / any_value(f) AS tide_fraction FROM k JOIN (SELECT site, max(tide_m) - min(tide_m) AS f FROM st GROUP BY 1) s ON k.site = s.site GROUP BY 1)"""


@query("tide_fraction", keys="site", digits={"tide_fraction": 6}, sql=f"WITH {FRACTION} SELECT * FROM fr")
def _(t):
    return regress.tide_fraction(station_pairs(t).select("site", F.col("t1_s").alias("ts_s")), site_tide(t))


@query("station_admittance", keys="site", ints="n", digits={"slope": 7, "tide_fraction": 6}, sql=f"""
WITH {FRACTION}, g AS (SELECT site, regr_slope(vsr, dt_days * 100) AS slope, count(*) AS n FROM spairs GROUP BY 1) SELECT g.*, tide_fraction FROM g JOIN fr USING (site) WHERE n >= 20 AND tide_fraction >= 0.5""")
def _(t):
    p = station_pairs(t)
    fit = regress.rate_regression(p.withColumn("x", F.col("dt_days") * 100), "x", "vsr", ["site"])
    return regress.station_gate(fit, regress.tide_fraction(p.select("site", F.col("t1_s").alias("ts_s")), site_tide(t)))


# Station profiles: a supplier is a site, the month a repeat, the quantity the depth.
SPROF = """sp AS (SELECT l_suppkey % 10 AS site, l_suppkey * 10 + CAST(year(l_shipdate) - 1995 AS INTEGER) AS pair, l_quantity AS z, avg(l_extendedprice) / 1e5 AS dh FROM lineitem GROUP BY 1, 2, 3),
hd AS (SELECT l_suppkey % 10 AS site, l_suppkey * 10 + CAST(year(l_shipdate) - 1995 AS INTEGER) AS pair, avg(l_discount) AS rate, 0.02 + avg(l_tax) / 10 AS dt FROM lineitem GROUP BY 1, 2),
us AS (SELECT site, pair FROM sp GROUP BY 1, 2 HAVING count(*) >= 20),
gk AS (SELECT us.site, us.pair, 6.0 + 4 * i AS z FROM us, range(11) AS r(i)),
sn AS (SELECT *, lead(z) OVER w AS z1, lead(dh) OVER w AS dh1 FROM sp WINDOW w AS (PARTITION BY site, pair ORDER BY z)),
gv AS (SELECT g.site, g.pair, g.z, CASE WHEN s.z = g.z THEN s.dh ELSE s.dh + (g.z - s.z) * (s.dh1 - s.dh) / (s.z1 - s.z) END AS dh FROM (SELECT * FROM gk) g ASOF LEFT JOIN sn s ON g.site = s.site AND g.pair = s.pair AND g.z >= s.z),
rd AS (SELECT gv.site, gv.z, count(*) AS n, regr_slope(dh / dt, rate * 100) AS slope, sqrt((regr_syy(dh / dt, rate * 100) - regr_slope(dh / dt, rate * 100) * regr_sxy(dh / dt, rate * 100)) / (count(*) - 2) / regr_sxx(dh / dt, rate * 100)) AS se
  FROM gv JOIN hd USING (site, pair) WHERE dh IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)"""


def _by_depth(t):
    key = [(F.col("l_suppkey") % 10).alias("site"), (F.col("l_suppkey") * 10 + F.year("l_shipdate") - 1995).alias("pair")]
    rows = t.lineitem.select(*key, "l_quantity", "l_extendedprice", "l_discount", "l_tax").repartition("site", "pair")     # a profile in one place
    sp = rows.groupBy("site", "pair", F.col("l_quantity").alias("z")).agg((F.avg("l_extendedprice") / 1e5).alias("dh"))
    hd = rows.groupBy("site", "pair").agg((F.avg("l_discount") * 100).alias("rate"), (0.02 + F.avg("l_tax") / 10).alias("dt"))
    return regress.rate_regression_by_depth(sp.join(hd, ["site", "pair"]), ["site"], ["pair"], "z", "dh", "dt", "rate", 6.0, 46.0, 4.0)


@query("rate_regression_by_depth", ints="site n", digits={"z": 1, "slope": 6, "se": 6}, sql=f"WITH {SPROF} SELECT * FROM rd")
def _(t):
    return _by_depth(t)


@query("depth_matched_strain", ints="site", digits={"z_top": 1, "z_bottom": 1, "mm_per_100m": 2, "sigma": 2}, sql=f"""
WITH {SPROF}, a AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY site ORDER BY abs(z - 11.1), z) = 1), b AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY site ORDER BY abs(z - 37.3), z) = 1)
SELECT site, a.z AS z_top, b.z AS z_bottom, 1e5 * (b.slope - a.slope) / (b.z - a.z) AS mm_per_100m, 1e5 * sqrt(a.se * a.se + b.se * b.se) / (b.z - a.z) AS sigma FROM a JOIN b USING (site)""")
def _(t):
    return regress.depth_matched_strain(_by_depth(t), ["site"], "z", 11.1, 37.3)


FIRN = FirnParams(max_depth=60.0, nz=601)


@query("const_index_to_true_depth", ints="l_partkey", digits={"true_depth": 6}, sql=f"""
WITH {FIRN_CTE}, tt AS (SELECT twtt * 299792458.0 / (2 * sqrt(3.18)) AS zc, d FROM firn), k AS (SELECT l_partkey, least(greatest(avg(l_quantity) * 1.5, 0), (SELECT max(zc) FROM tt)) AS z FROM lineitem GROUP BY 1)
{_interp('k', 'z', 'tt', 'zc', 'd', 'true_depth')}""")
def _(t):
    d = t.lineitem.groupBy("l_partkey").agg((F.avg("l_quantity") * 1.5).alias("z"))
    return firn.const_index_to_true_depth(d, "z", firn.firn_table(t.spark, FIRN), FIRN)


# --- pass gate --------------------------------------------------------------

GATED = """hts AS (SELECT user_id % 5 AS line_id, user_id AS col, CAST(floor((t - 1704067200) / 86400) AS INTEGER) AS pass_idx, value AS z FROM ev WHERE event_type = 'click'),
td AS (SELECT CAST(floor((t - 1704067200) / 86400) AS INTEGER) AS pass_idx, avg(value) AS tide FROM ev WHERE event_type = 'view' GROUP BY 1),
lm AS (SELECT line_id, pass_idx, avg(z) AS m, any_value(tide) AS tide FROM hts JOIN td USING (pass_idx) GROUP BY 1, 2),
f1 AS (SELECT line_id, regr_slope(m, tide) AS s, regr_intercept(m, tide) AS i FROM lm GROUP BY 1), r1 AS (SELECT lm.*, m - i - s * tide AS r FROM lm JOIN f1 USING (line_id)),
md AS (SELECT line_id, median(r) AS med FROM r1 GROUP BY 1), sd AS (SELECT line_id, any_value(med) AS med, 1.4826 * median(abs(r - med)) AS sd FROM r1 JOIN md USING (line_id) GROUP BY 1),
ok AS (SELECT r1.*, NOT (sd > 0 AND abs(r - med) > 2 * sd) AS pass_ok FROM r1 JOIN sd USING (line_id)),
f2 AS (SELECT line_id, regr_slope(m, tide) AS s, regr_intercept(m, tide) AS i FROM ok WHERE pass_ok GROUP BY 1), r2 AS (SELECT ok.line_id, ok.pass_idx, ok.pass_ok, tide, m, m - i - s * tide AS resid, s FROM ok JOIN f2 USING (line_id)),
zb AS (SELECT line_id, col AS block, pass_idx, avg(z) AS y FROM hts GROUP BY 1, 2, 3),
mm AS (SELECT line_id, block, count(*) AS n, var_pop(tide) * count(*) AS tt, var_pop(resid) * count(*) AS hh, covar_pop(tide, resid) * count(*) AS th, covar_pop(tide, y) * count(*) AS ty, covar_pop(resid, y) * count(*) AS hy, var_pop(y) * count(*) AS yy
  FROM zb JOIN r2 USING (line_id, pass_idx) WHERE pass_ok GROUP BY 1, 2)"""


def _gated(t):
    day = F.floor((F.col("t") - 1704067200) / 86400).cast("int")
    h = I.series(t, "click").select((F.col("user_id") % 5).alias("line_id"), F.col("user_id").alias("col"), day.alias("pass_idx"), F.col("value").alias("z"))
    d = I.series(t, "view").groupBy(day.alias("pass_idx")).agg(F.avg("value").alias("tide_m"))
    tide = h.select("line_id", "pass_idx").distinct().join(d, "pass_idx")
    return regress.fit_slope_gated(h, tide, ["line_id"], F.col("col"), None, max_sigma=2.0)


@query("gated_slope", ints="line_id block n", digits={"a": 5, "a_std": 5}, sql=f"""
WITH {I.EVENTS}, {GATED}, s AS (SELECT *, (ty * hh - hy * th) / (tt * hh - th * th) AS b, (hy * tt - ty * th) / (tt * hh - th * th) AS c FROM mm)
SELECT line_id, block, CASE WHEN n >= 5 THEN n ELSE 0 END AS n, CASE WHEN n >= 5 THEN b END AS a, CASE WHEN n >= 5 THEN sqrt((yy - b * ty - c * hy) / nullif(n - 3, 0) * hh / (tt * hh - th * th)) END AS a_std FROM s""")
def _(t):
    return _gated(t)[0]


@query("pass_gate", keys="pass_ok", ints="line_id pass_idx", digits={"pass_resid": 6, "slope": 7}, sql=f"WITH {I.EVENTS}, {GATED} SELECT line_id, pass_idx, pass_ok, resid AS pass_resid, s AS slope FROM r2")
def _(t):
    return _gated(t)[1]


GATED_HOURS = f"""{I.EVENTS}, hts AS (SELECT user_id AS line_id, CAST(floor(t / 3600) % 24 AS INTEGER) AS col, CAST(floor((t - 1704067200) / 86400) AS INTEGER) AS pass_idx, value AS z FROM ev WHERE event_type = 'click'),
td AS (SELECT CAST(floor((t - 1704067200) / 86400) AS INTEGER) AS pass_idx, avg(value) AS tide FROM ev WHERE event_type = 'view' GROUP BY 1),
lm AS (SELECT *, count(tide) OVER (PARTITION BY line_id) AS n_ok FROM (SELECT line_id, pass_idx, avg(z) AS m, any_value(tide) AS tide FROM hts LEFT JOIN td USING (pass_idx) GROUP BY 1, 2)),
zb AS (SELECT line_id, col // 7 AS block, pass_idx, avg(z) AS y FROM hts WHERE col // 7 < 24 // 7 GROUP BY 1, 2, 3),
mm AS (SELECT line_id, block, max(n_ok) AS n_ok, count(tide) FILTER (n_ok >= 5) AS n, var_pop(tide) FILTER (n_ok >= 5) AS tt FROM zb JOIN lm USING (line_id, pass_idx) GROUP BY 1, 2)"""


@query("gated_slope_status", keys="status", ints="line_id block n", sql=f"""
WITH {GATED_HOURS} SELECT line_id, block, CASE WHEN n_ok >= 5 AND n >= 5 AND tt > 0 THEN n ELSE 0 END AS n,
  CASE WHEN n_ok < 5 THEN 'few_passes' WHEN n < 5 THEN 'few_samples' WHEN tt > 0 THEN 'fitted' ELSE 'collinear' END AS status FROM mm""")
def _(t):
    # Users as lines, hours as columns, blocks of 7 hours of which the last is incomplete; no pass is gated out.
    day = F.floor((F.col("t") - 1704067200) / 86400).cast("int")
    h = I.series(t, "click").select(F.col("user_id").alias("line_id"), (F.floor(F.col("t") / 3600) % 24).cast("int").alias("col"), day.alias("pass_idx"), F.col("value").alias("z"))
    d = I.series(t, "view").groupBy(day.alias("pass_idx")).agg(F.avg("value").alias("tide_m"))
    tide = h.select("line_id", "pass_idx").distinct().join(d, "pass_idx")
    block = F.floor(F.col("col") / 7)
    return regress.fit_slope_gated(h, tide, ["line_id"], block, block < 24 // 7, max_sigma=1e9, common_mode=False)[0]


# --- depth fits -------------------------------------------------------------

LEG_PROFILE = "lp AS (SELECT l_suppkey AS row_key, l_quantity AS z, avg(l_extendedprice) / 1e5 AS v, stddev_samp(l_extendedprice) / 1e5 AS s FROM lineitem GROUP BY 1, 2)"
LEG = LEG_PROFILE + """,
sel AS (SELECT *, max(z) OVER (PARTITION BY row_key) AS h FROM lp WHERE z >= 5),
b AS (SELECT *, CASE WHEN s > 0 THEN 1 / (s * s) ELSE 0 END AS w, 2 * z / h - 1 AS p1 FROM sel), bb AS (SELECT *, (3 * p1 * p1 - 1) / 2 AS p2 FROM b),
ne AS (SELECT row_key, count(*) AS n, any_value(h) AS h, min(z) AS top, sum(w) AS a, sum(w*p1) AS b, sum(w*p2) AS c, sum(w*p1*p1) AS d, sum(w*p1*p2) AS e, sum(w*p2*p2) AS f, sum(w*v) AS g0, sum(w*p1*v) AS g1, sum(w*p2*v) AS g2 FROM bb GROUP BY 1),
dt AS (SELECT *, a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c) AS det FROM ne),
cf AS (SELECT *, (g0*(d*f-e*e) - b*(g1*f-e*g2) + c*(g1*e-d*g2)) / det AS c0, (a*(g1*f-e*g2) - g0*(b*f-e*c) + c*(b*g2-g1*c)) / det AS c1, (a*(d*g2-g1*e) - b*(b*g2-g1*c) + g0*(b*e-d*c)) / det AS c2 FROM dt),
rs AS (SELECT row_key, sqrt(sum(w * pow(v - c0 - c1*p1 - c2*p2, 2)) / sum(w)) AS rms FROM bb JOIN cf USING (row_key) GROUP BY 1)"""


def supplier_profile(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("row_key"), F.col("l_quantity").alias("z")).agg(
        (F.avg("l_extendedprice") / 1e5).alias("v"), (F.stddev_samp("l_extendedprice") / 1e5).alias("s"))


def _legendre(t):
    return regress.legendre_fit(supplier_profile(t), "z", "v", "s", ["row_key"], order=2, top=5.0, per_look=2.0)


@query("legendre_fit", ints="row_key n", digits={"c0": 7, "c1": 7, "c2": 7, "s1": 8, "s2": 8, "strain_mean": 8, "rms": 7}, sql=f"""
WITH {LEG} SELECT row_key, n, c0, c1, c2, 2 * c1 / h AS s1, 6 * c2 / h AS s2,
 (c1 * (1 - (2*top/h - 1)) + c2 * (1 - (3*pow(2*top/h - 1, 2) - 1) / 2)) / (h - top) AS strain_mean, rms FROM cf JOIN rs USING (row_key)""")
def _(t):
    return _legendre(t).select("row_key", "n", "s1", "s2", "strain_mean", "rms", *[F.col("coef")[k].alias(f"c{k}") for k in range(3)])


@query("short_block_mask", keys="short", ints="row_key", digits={"top": 3, "bottom": 3, "s1": 8}, sql=f"""
WITH {LEG} SELECT row_key, h - top < 44.5 AS short, top, h AS bottom, CASE WHEN h - top >= 44.5 THEN 2 * c1 / h END AS s1 FROM cf""")
def _(t):
    return regress.mask_short_blocks(_legendre(t), 44.5)


@query("fitted_profile", ints="row_key", digits={"z": 6, "fit": 7, "strain": 8}, sql=f"""
WITH {LEG} SELECT row_key, z, c0 + c1*x + c2*(3*x*x - 1)/2 AS fit, 2/h * (c1 + 3*c2*x) AS strain FROM (SELECT *, 2*z/h - 1 AS x FROM (SELECT *, top + (h - top) * i / 20 AS z FROM cf, range(21) AS r(i)))""")
def _(t):
    return regress.fitted_profile(_legendre(t), ["row_key"], 2, nz=21)


# The p-value of t by the angle atan(t / sqrt(dof)): Simpson's rule over cos(angle) to the power of dof - 1.
@query("legendre_significance", ints="row_key", digits={"p_quad": 6, "sd2": 8}, sql=f"""
WITH {LEG}, se AS (SELECT row_key, sum(w * pow(v - c0 - c1*p1 - c2*p2, 2)) AS sse FROM bb JOIN cf USING (row_key) GROUP BY 1),
q AS (SELECT row_key, c2, greatest(greatest(n / 2.0, 4) - 3, 1) AS dof, sse, (a*d - b*b) / det AS i22 FROM cf JOIN se USING (row_key)),
t AS (SELECT row_key, dof, sqrt(abs(i22 * sse / dof)) AS sd2, atan(abs(c2 / sqrt(abs(i22 * sse / dof))) / sqrt(dof)) AS th FROM q)
SELECT row_key, any_value(sd2) AS sd2, 1 - sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(th * k / 2000), dof - 1)) * any_value(th) / 6000 * 2 * exp(any_value(lgamma((dof + 1) / 2) - lgamma(dof / 2) - lgamma(0.5))) AS p_quad
FROM t, range(2001) AS r(k) GROUP BY row_key""")
def _(t):
    return _legendre(t).select("row_key", "p_quad", F.col("coef_std")[2].alias("sd2"))


@query("legendre_correlated", ints="row_key n", digits={"chi2": 6, "corr_len": 1, "sd1": 8}, sql=f"""
WITH {LEG_PROFILE}, sp AS (SELECT *, z - min(z) OVER (PARTITION BY row_key) AS zz, max(z) OVER (PARTITION BY row_key) - min(z) OVER (PARTITION BY row_key) AS h FROM lp WHERE s > 0 AND v IS NOT NULL),
b AS (SELECT *, 1 / (s * s) AS w, 2 * zz / h - 1 AS p1 FROM sp WHERE h > 0), bb AS (SELECT *, (3 * p1 * p1 - 1) / 2 AS p2 FROM b),
ne AS (SELECT row_key, count(*) AS n, sum(w) AS a, sum(w*p1) AS b, sum(w*p2) AS c, sum(w*p1*p1) AS d, sum(w*p1*p2) AS e, sum(w*p2*p2) AS f, sum(w*v) AS g0, sum(w*p1*v) AS g1, sum(w*p2*v) AS g2 FROM bb GROUP BY 1 HAVING count(*) >= 4),
dt AS (SELECT *, a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c) AS det FROM ne),
cf AS (SELECT *, (g0*(d*f-e*e) - b*(g1*f-e*g2) + c*(g1*e-d*g2)) / det AS c0, (a*(g1*f-e*g2) - g0*(b*f-e*c) + c*(b*g2-g1*c)) / det AS c1, (a*(d*g2-g1*e) - b*(b*g2-g1*c) + g0*(b*e-d*c)) / det AS c2 FROM dt),
rr AS (SELECT row_key, z, w, v - c0 - c1*p1 - c2*p2 AS r FROM bb JOIN cf USING (row_key)), rc AS (SELECT *, r - avg(r) OVER (PARTITION BY row_key) AS rc, row_number() OVER (PARTITION BY row_key ORDER BY z) AS i FROM rr),
ac AS (SELECT x.row_key, y.i - x.i AS l, sum(x.rc * y.rc) AS c FROM rc x JOIN rc y ON x.row_key = y.row_key AND y.i >= x.i GROUP BY 1, 2),
ln AS (SELECT a.row_key, greatest(coalesce(min(a.l) FILTER (a.c < z.c / exp(1) AND z.c > 0), 0), 1) AS corr_len FROM ac a JOIN ac z ON z.row_key = a.row_key AND z.l = 0 GROUP BY 1),
x2 AS (SELECT row_key, sum(w * r * r) AS sse FROM rr GROUP BY 1)
SELECT row_key, n, sse / greatest(n - 3, 1) AS chi2, corr_len, sqrt((a*f - c*c) / det * greatest(sse / greatest(n - 3, 1), 1) * corr_len) AS sd1 FROM cf JOIN ln USING (row_key) JOIN x2 USING (row_key)""")
def _(t):
    return regress.legendre_correlated(supplier_profile(t), "z", "v", "s", ["row_key"]).select("row_key", "n", "chi2", "corr_len", F.col("coef_sd")[1].alias("sd1"))


@query("profile_decompose", ints="row_key", digits={"gradient": 6, "gradient_err": 6, "level": 6, "level_err": 6}, sql=f"""
WITH {LEG_PROFILE}, o AS (SELECT * FROM lp WHERE s IS NOT NULL), a AS (SELECT row_key, 100 * regr_slope(v, z) AS gradient, 100 * sqrt(pow(arg_min(s, z), 2) + pow(arg_max(s, z), 2)) / (max(z) - min(z)) AS gradient_err FROM o GROUP BY 1),
b AS (SELECT row_key, v, s FROM o QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY abs(z - 30.3), z) = 1) SELECT a.*, b.v AS level, b.s AS level_err FROM a JOIN b USING (row_key)""")
def _(t):
    return regress.profile_decompose(supplier_profile(t).where("s is not null"), "z", "v", "s", ["row_key"], 30.3)


@query("depth_response", ints="ord k row_key", digits={"driver": 7, "driver_std": 7})
def _(t):
    """Every Legendre coefficient of the pair profiles through the network and the joint fit, by order."""
    y = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").alias("nation"), I.year_pass().alias("pass_idx"), F.col("l_quantity").alias("z")).agg(
        (F.avg("l_extendedprice") / 1e5).alias("v"), (F.stddev_samp("l_extendedprice") / 1e5).alias("s"))
    p = pairs.pair_samples(y, key=["nation", "z"], values=["v", "s"])
    p = p.select(F.col("nation").alias("row_key"), "ref_idx", "sec_idx", "z", (F.col("sec_v") - F.col("ref_v")).alias("dh"),
                 F.sqrt(F.col("ref_s") * F.col("ref_s") + F.col("sec_s") * F.col("sec_s")).alias("sd"))
    drv = t.lineitem.groupBy(I.year_pass().alias("epoch")).agg((F.avg("l_discount") * 1000).alias("h"))
    return chains.depth_response(p, drv, ["row_key"], orders=(1, 2, 3))


PLATE = """cfs AS (SELECT l_suppkey AS row_key, CAST(l_linenumber - 1 AS INTEGER) AS k, avg(l_extendedprice) / 1e4 AS adm, stddev_samp(l_extendedprice) / 1e4 AS sd FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
good AS (SELECT row_key FROM cfs GROUP BY 1 HAVING count(*) = 4 AND min(CASE WHEN sd > 0 THEN 1 ELSE 0 END) = 1),
tr AS (SELECT c.row_key, i, -50.0 + 10 * i AS zn, 1 / (sd * sd) AS w, adm, CASE k WHEN 1 THEN (-50.0 + 10 * i) * 50 - 2500 WHEN 2 THEN -10000.0 / 12 ELSE 0 END AS m FROM cfs c JOIN good USING (row_key), range(41) AS r(i) WHERE k >= 1),
js AS (SELECT row_key, i, any_value(zn) AS zn, sum(w*m*adm) / sum(w*m*m) AS amp, sum(w*m*m) AS mm, sum(w*adm*adm) - pow(sum(w*m*adm), 2) / sum(w*m*m) AS J FROM tr GROUP BY 1, 2),
best AS (SELECT * FROM js QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY J, i) = 1),
ins AS (SELECT js.row_key, min(js.i) AS lo, max(js.i) AS hi FROM js JOIN best b USING (row_key) WHERE js.J <= b.J + 1 GROUP BY 1)"""


@query("plate_shape_fit", ints="row_key", digits={"zn": 2, "zn_lo": 2, "zn_hi": 2, "amp": 9, "significance": 5, "chi2": 6}, sql=f"""
WITH {PLATE} SELECT row_key, zn, CASE WHEN i > 0 AND i < 40 AND lo > 0 THEN -50.0 + 10 * lo END AS zn_lo, CASE WHEN i > 0 AND i < 40 AND hi < 40 THEN -50.0 + 10 * hi END AS zn_hi, amp, amp * sqrt(mm) AS significance, greatest(J, 0) / 2 AS chi2
FROM best JOIN ins USING (row_key)""")
def _(t):
    c = t.lineitem.where("l_linenumber <= 4").groupBy(F.col("l_suppkey").alias("row_key"), (F.col("l_linenumber") - 1).alias("k")).agg(
        (F.avg("l_extendedprice") / 1e4).alias("adm"), (F.stddev_samp("l_extendedprice") / 1e4).alias("sd"))
    return profiles.plate_shape(c, ["row_key"], 3, 100.0, [-50.0 + 10 * i for i in range(41)])


@query("unwrapped_slope", ints="block n", digits={"slope": 6}, sql=f"WITH {SERIES} SELECT block, count(*) AS n, sum(y * h) / sum(h * h) AS slope FROM s GROUP BY 1")
def _(t):
    return regress.origin_slope(block_series(t), "h", "y", ["block"])


@query("artefact_correlation", keys="line_id", ints="n", digits={"r": 6, "max_slope": 6}, sql="""
WITH g AS (SELECT p_brand AS line_id, l_linenumber AS block, regr_slope(l_extendedprice / 1e4, l_quantity / 10) AS g, avg(l_discount) * 100 AS a FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT line_id, count(*) AS n, corr(g, a) AS r, max(abs(g)) AS max_slope FROM g GROUP BY 1""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("line_id"), F.col("l_linenumber").alias("block"), (F.col("l_extendedprice") / 1e4).alias("resid"), (F.col("l_quantity") / 10).alias("tide"), "l_discount")
    resp = d.groupBy("line_id", "block").agg((F.avg("l_discount") * 100).alias("response"))
    return regress.artefact_correlation(d, resp, ["line_id"], p_value=False)


@query("removed_vs_predicted", ints="block n", digits={"slope": 6, "r": 6, "removed_sd": 6, "resid_sd": 6}, sql=f"""
WITH {SERIES} SELECT block, count(*) AS n, regr_slope(y, h) AS slope, corr(y, h) AS r, stddev_samp(y) AS removed_sd, sqrt((regr_syy(y, h) - regr_slope(y, h) * regr_sxy(y, h)) / (count(*) - 1)) AS resid_sd FROM s GROUP BY 1""")
def _(t):
    return regress.removed_vs_predicted(block_series(t), ["block"], "y", "h")


# --- coherent scans ---------------------------------------------------------

GRID = [-2 + 0.1 * k for k in range(41)]
PHASE_FIELD = "pf AS (SELECT event_type AS cell, cos(value / 50) AS re, sin(value / 50) AS im, 1 + (user_id % 3) AS w, extract(hour FROM ts) / 12.0 - 1 AS ph FROM events)"
SPECTRUM = """sp AS (SELECT cell, -2 + 0.1 * i AS a, i, count(*) AS n, sqrt(pow(sum(w * (re * cos(ph * (-2 + 0.1 * i)) + im * sin(ph * (-2 + 0.1 * i)))), 2) + pow(sum(w * (im * cos(ph * (-2 + 0.1 * i)) - re * sin(ph * (-2 + 0.1 * i)))), 2)) / sum(w * sqrt(re * re + im * im)) AS f
  FROM pf, range(41) AS r(i) GROUP BY cell, i)"""
PHASE = f"{PHASE_FIELD}, {SPECTRUM}"
TURNED = "pf1 AS (SELECT cell, re * cos(0.3 * ph) - im * sin(0.3 * ph) AS re, im * cos(0.3 * ph) + re * sin(0.3 * ph) AS im, w, ph FROM pf)"


def phase_field(t):
    return t.events.select(F.col("event_type").alias("cell"), F.cos(F.col("value") / 50).alias("re"), F.sin(F.col("value") / 50).alias("im"),
                           (1 + F.col("user_id") % 3).cast("double").alias("w"), (F.hour("ts") / 12 - 1).alias("ph"))


@query("coherent_spectrum", keys="cell", ints="n", digits={"a": 3, "f": 7}, sql=f"WITH {PHASE} SELECT cell, n, a, f FROM sp")
def _(t):
    return coherent.coherent_spectrum(phase_field(t), ["cell"], F.col("ph"), GRID)


@query("coherent_scan", keys="cell", ints="n", digits={"a": 3, "f": 7}, sql=f"WITH {PHASE} SELECT cell, n, a, f FROM sp QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(f, 12) DESC, i) = 1")
def _(t):
    return coherent.coherent_scan(phase_field(t), ["cell"], F.col("ph"), GRID)


@query("injection_self_test", keys="cell edge", digits={"a": 3, "shift": 3, "err": 5}, sql=f"""
WITH {PHASE}, {TURNED}, {SPECTRUM.replace('sp AS', 'sp1 AS').replace('FROM pf,', 'FROM pf1,')},
b0 AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(f, 12) DESC, i) = 1), b1 AS (SELECT * FROM sp1 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(f, 12) DESC, i) = 1)
SELECT b0.cell, abs(b0.a) > 2 - 1.5 * 0.3 AS edge, b0.a AS a, b1.a - b0.a AS shift, abs(b1.a - b0.a - 0.3) AS err FROM b0 JOIN b1 ON b0.cell = b1.cell""")
def _(t):
    return coherent.injection_self_test(phase_field(t), ["cell"], F.col("ph"), GRID, inject=0.3)


FIELD = I.PAIRDIFF.replace("pairdiff AS", "pd AS") + """, yr AS (SELECT CAST(year(l_shipdate) - 1994 AS INTEGER) AS ep, avg(l_discount) * 1000 AS h FROM lineitem GROUP BY 1),
field AS (SELECT row_key, ref_idx, sec_idx, cos(3 * d) AS re, sin(3 * d) AS im, n / (n + 10.0) AS w, b.h - a.h AS dt, (sec_idx - ref_idx) / 3.0 AS rg FROM pd JOIN yr a ON a.ep = ref_idx JOIN yr b ON b.ep = sec_idx)"""


def pair_field(t):
    yr = t.lineitem.groupBy(I.year_pass().alias("ep")).agg((F.avg("l_discount") * 1000).alias("h"))
    a, b = yr.select(F.col("ep").alias("ref_idx"), F.col("h").alias("_a")), yr.select(F.col("ep").alias("sec_idx"), F.col("h").alias("_b"))
    p = I.pairdiff(t).join(a, "ref_idx").join(b, "sec_idx")
    return p.select("row_key", "ref_idx", "sec_idx", F.cos(3 * F.col("d")).alias("re"), F.sin(3 * F.col("d")).alias("im"), (F.col("n") / (F.col("n") + 10.0)).alias("w"),
                    (F.col("_b") - F.col("_a")).alias("dt"), ((F.col("sec_idx") - F.col("ref_idx")) / 3).alias("rg"))


SCORE = "sqrt(pow(sum(w * (re * cos({p}) + im * sin({p}))), 2) + pow(sum(w * (im * cos({p}) - re * sin({p}))), 2)) / sum(w * sqrt(re * re + im * im))"


@query("coherent_scan_jackknife", keys="row_key", ints="n", digits={"a": 3, "f": 7, "a_sd": 6}, sql=f"""
WITH {FIELD}, lo AS (SELECT f.*, 0 AS q FROM field f UNION ALL SELECT f.*, q FROM field f, range(1, 8) AS r(q) WHERE ref_idx <> q AND sec_idx <> q),
sc AS (SELECT row_key, q, i, -2 + 0.1 * i AS a, count(*) AS n, {SCORE.format(p='dt * (-2 + 0.1 * i)')} AS f FROM lo, range(41) AS r(i) GROUP BY row_key, q, i),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY row_key, q ORDER BY round(f, 12) DESC, i) = 1)
SELECT row_key, max(n) FILTER (q = 0) AS n, max(a) FILTER (q = 0) AS a, max(f) FILTER (q = 0) AS f, sqrt((count(*) - 2) * var_pop(a) FILTER (q > 0)) AS a_sd FROM b GROUP BY 1""")
def _(t):
    return coherent.coherent_scan_packed(pair_field(t), ["row_key"], F.lit(1.0), "dt", GRID)


G2A, G2B = [-2 + 0.2 * k for k in range(21)], [-1.5 + 0.15 * k for k in range(21)]


@query("coherent_scan_2d", keys="row_key", ints="n", digits={"a": 3, "b": 3, "f": 7, "r_reg": 7}, sql=f"""
WITH {FIELD}, sc AS (SELECT row_key, i, j, -2 + 0.2 * i AS a, -1.5 + 0.15 * j AS b, count(*) AS n, corr(rg, dt) AS r_reg, {SCORE.format(p='(dt * (-2 + 0.2 * i) + rg * (-1.5 + 0.15 * j))')} AS f FROM field, range(21) AS r(i), range(21) AS s(j) GROUP BY row_key, i, j)
SELECT row_key, n, a, b, f, r_reg FROM sc QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY round(f, 12) DESC, i, j) = 1""")
def _(t):
    return coherent.coherent_scan_2d(pair_field(t), ["row_key"], F.lit(1.0), "dt", "rg", G2A, G2B)


@query("coherent_fit_linear", keys="row_key", ints="n", digits={"f": 6, "a": 5, "b": 5})
def _(t):
    s = coherent.coherent_scan_2d(pair_field(t), ["row_key"], F.lit(1.0), "dt", "rg", G2A, G2B).select("row_key", F.col("a").alias("a0"), F.col("b").alias("b0"))
    d = coherent.coherent_fit(pair_field(t).join(s, "row_key"), ["row_key"], F.lit(1.0), ["dt", "rg"], ["a0", "b0"])
    return d.select("row_key", "n", "f", F.col("theta")[0].alias("a"), F.col("theta")[1].alias("b"))


@query("jackknife_by_entity", keys="c_mktsegment", ints="n_ratio", digits={"se_ratio": 6}, sql="""
WITH s AS (SELECT c_mktsegment, c_nationkey AS q, sum(o_totalprice) AS p, sum(c_acctbal) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
l AS (SELECT c_mktsegment, q, (sum(p) OVER w - p) / (sum(b) OVER w - b) AS e FROM s WINDOW w AS (PARTITION BY c_mktsegment))
SELECT c_mktsegment, count(*) AS n_ratio, sqrt((count(*) - 1) * var_pop(e)) AS se_ratio FROM l GROUP BY 1""")
def _(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return coherent.jackknife_sums(d, ["c_mktsegment"], ["c_nationkey"], {"p": F.col("o_totalprice"), "b": F.col("c_acctbal")}, {"ratio": lambda s: s["p"] / s["b"]})


@query("jackknife_estimator", keys="row_key", ints="n_slope", digits={"se_slope": 7}, sql=f"""
WITH {I.PAIRDIFF}, lo AS (SELECT row_key, q, regr_slope(d, sec_idx - ref_idx) AS e FROM pairdiff, range(1, 8) AS r(q) WHERE ref_idx <> q AND sec_idx <> q GROUP BY 1, 2)
SELECT row_key, count(*) AS n_slope, sqrt((count(*) - 1) * var_pop(e)) AS se_slope FROM lo GROUP BY 1""")
def _(t):
    d = I.pairdiff(t).withColumn("gap", F.col("sec_idx") - F.col("ref_idx"))
    return coherent.jackknife(d, ["row_key"], ["ref_idx", "sec_idx"], lambda x, by: regress.rate_regression(x, "gap", "d", by), ["slope"])


LCG = "WITH RECURSIVE g AS (SELECT 1 AS q, CAST((16807 * CAST(4 AS BIGINT)) % 2147483647 AS BIGINT) AS x UNION ALL SELECT q + 1, (16807 * x) % 2147483647 FROM g WHERE q < {n})"


@query("bootstrap_index", ints="rep k idx pair_no", sql=f"""
{LCG.format(n=2500)}, nb AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS no FROM (SELECT DISTINCT p_brand FROM part))
SELECT (q - 1) // 25 + 1 AS rep, (q - 1) % 25 + 1 AS k, least(25, floor(x / 2147483647.0 * 25) + 1) AS idx, no AS pair_no FROM g JOIN nb ON no = least(25, floor(x / 2147483647.0 * 25) + 1)""")
def _(t):
    from pyspark.sql import Window
    brands = t.part.select("p_brand").distinct().select(F.row_number().over(Window.orderBy("p_brand")).alias("pair_no"))
    return coherent.bootstrap_index(t.spark, 3, 25, 100).join(brands, F.col("idx") == F.col("pair_no"))


BOOT_FIELD = FIELD + ", bf AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY ref_idx, sec_idx) AS pair_no FROM field)"


@query("bootstrap_pairs", keys="row_key", ints="n_rep", digits={"a_sd_boot": 7}, sql=f"""
{LCG.format(n=420)}, {BOOT_FIELD}, ix AS (SELECT (q - 1) // 21 + 1 AS rep, CAST(least(21, floor(x / 2147483647.0 * 21) + 1) AS BIGINT) AS pair_no FROM g),
sc AS (SELECT row_key, rep, i, -2 + 0.1 * i AS a, {SCORE.format(p='dt * (-2 + 0.1 * i)')} AS f FROM bf JOIN ix USING (pair_no), range(41) AS r(i) GROUP BY row_key, rep, i),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY row_key, rep ORDER BY round(f, 12) DESC, i) = 1) SELECT row_key, count(*) AS n_rep, stddev_samp(a) AS a_sd_boot FROM b GROUP BY 1""")
def _(t):
    from pyspark.sql import Window
    f = pair_field(t).withColumn("pair_no", F.row_number().over(Window.partitionBy("row_key").orderBy("ref_idx", "sec_idx")))
    return coherent.bootstrap_scan(f, ["row_key"], ["row_key"], F.col("dt"), GRID, 3, 20)


# Lines of unequal size: every other brand has no pairs of the last pass.
@query("bootstrap_lines", keys="row_key", ints="n_rep", digits={"a_sd_boot": 7}, sql=f"""
{LCG.format(n=420)}, {FIELD}, bf AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY ref_idx, sec_idx) AS pair_no FROM field WHERE sec_idx < 7 OR CAST(right(row_key, 1) AS INTEGER) % 2 = 1),
sz AS (SELECT row_key, count(*) AS n FROM bf GROUP BY 1), ix AS (SELECT row_key, (q - 1) // n + 1 AS rep, CAST(least(n, floor(x / 2147483647.0 * n) + 1) AS BIGINT) AS pair_no FROM g JOIN sz ON q <= 20 * n),
sc AS (SELECT row_key, rep, i, -2 + 0.1 * i AS a, {SCORE.format(p='dt * (-2 + 0.1 * i)')} AS f FROM bf JOIN ix USING (row_key, pair_no), range(41) AS r(i) GROUP BY row_key, rep, i),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY row_key, rep ORDER BY round(f, 12) DESC, i) = 1) SELECT row_key, count(*) AS n_rep, stddev_samp(a) AS a_sd_boot FROM b GROUP BY 1""")
def _(t):
    from pyspark.sql import Window
    f = pair_field(t).where((F.col("sec_idx") < 7) | (F.substring("row_key", -1, 1).cast("int") % 2 == 1))
    f = f.withColumn("pair_no", F.row_number().over(Window.partitionBy("row_key").orderBy("ref_idx", "sec_idx")))
    return coherent.bootstrap_scan(f, ["row_key"], ["row_key"], F.col("dt"), GRID, 3, 20)


LAG = """cells AS (SELECT p_brand AS line_id, l_partkey AS cell, avg(l_extendedprice) / 1e4 - 5 AS a, avg(l_quantity) / 10 - 2.5 AS b, stddev_samp(l_extendedprice) / 1e4 AS sa, stddev_samp(l_quantity) / 10 AS sb
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
ck AS (SELECT line_id, i, -6.21 + i * 12.42 / 240 AS tau, count(*) AS n, sum(pow(a * sin(2 * pi() / 24.84 * (-6.21 + i * 12.42 / 240)) + b * cos(2 * pi() / 24.84 * (-6.21 + i * 12.42 / 240)), 2) / ((sa * sa + sb * sb) / 2)) AS c2,
  sum(a * a / (sa * sa)) / count(*) AS chi2_a, sum(b * b / (sb * sb)) / count(*) AS chi2_b FROM cells, range(241) AS r(i) WHERE sa > 0 AND sb > 0 GROUP BY line_id, i),
bk AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY c2, i) = 1),
ot AS (SELECT ck.line_id, max(ck.i) FILTER (ck.i < b.i) AS lo, min(ck.i) FILTER (ck.i > b.i) AS hi FROM ck JOIN bk b USING (line_id) WHERE ck.c2 > b.c2 + greatest(1, b.c2 / (b.n - 1)) GROUP BY 1),
lag AS (SELECT bk.line_id, n, tau AS tau_h, -6.21 + (lo + 1) * 12.42 / 240 AS tau_lo, -6.21 + (hi - 1) * 12.42 / 240 AS tau_hi, c2 / (n - 1) AS chi2r, chi2_a, chi2_b FROM bk LEFT JOIN ot USING (line_id))"""


def _lags(t):
    c = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("line_id"), "l_partkey").agg(
        (F.avg("l_extendedprice") / 1e4 - 5).alias("a"), (F.avg("l_quantity") / 10 - 2.5).alias("b"), (F.stddev_samp("l_extendedprice") / 1e4).alias("sa"), (F.stddev_samp("l_quantity") / 10).alias("sb"))
    return coherent.common_lag(c, ["line_id"], "a", "b", "sa", "sb", n_lag=241)


@query("common_lag_fit", keys="line_id", ints="n", digits={"tau_h": 5, "tau_lo": 5, "tau_hi": 5, "chi2r": 5, "chi2_a": 5, "chi2_b": 5}, sql=f"WITH {LAG} SELECT * FROM lag")
def _(t):
    return _lags(t)


@query("lag_across_lines", ints="n_lines", digits={"tau_h": 6, "se_h": 6}, sql=f"WITH {LAG} SELECT count(*) AS n_lines, avg(tau_h) AS tau_h, stddev_samp(tau_h) / sqrt(count(*)) AS se_h FROM lag")
def _(t):
    return coherent.across_lines(_lags(t))


# --- the chain --------------------------------------------------------------


@query("flagship", keys="row_key", ints="n dof", digits={"trend": 6, "driver": 6, "driver_std": 6, "r_th": 6}, sql=f"""
WITH {I.PAIRDIFF}, bth AS (SELECT row_key, sec_idx AS ep, d FROM pairdiff UNION ALL SELECT row_key, ref_idx, -d FROM pairdiff), x AS (SELECT row_key, ep, sum(d) / 7 AS x FROM bth GROUP BY 1, 2),
yr AS (SELECT CAST(year(l_shipdate) - 1994 AS INTEGER) AS ep, avg(l_discount) * 1000 AS h FROM lineitem GROUP BY 1), q AS (SELECT row_key, x AS y, CAST(ep AS DOUBLE) AS t, h FROM x JOIN yr USING (ep)),
m AS (SELECT row_key, count(*) AS n, var_pop(t) * count(*) AS tt, var_pop(h) * count(*) AS hh, covar_pop(t, h) * count(*) AS th, covar_pop(t, y) * count(*) AS ty, covar_pop(h, y) * count(*) AS hy, var_pop(y) * count(*) AS yy FROM q GROUP BY 1),
f AS (SELECT *, (ty * hh - hy * th) / (tt * hh - th * th) AS b, (hy * tt - ty * th) / (tt * hh - th * th) AS c FROM m)
SELECT row_key, n, n - 3 AS dof, b AS trend, c AS driver, sqrt((yy - b * ty - c * hy) / (n - 3) * tt / (tt * hh - th * th)) AS driver_std, th / sqrt(tt * hh) AS r_th FROM f""")
def _(t):
    """Pair differences to epoch values (network) to trend and driver response, per row."""
    drv = t.lineitem.groupBy(I.year_pass().alias("epoch")).agg((F.avg("l_discount") * 1000).alias("h"))
    drv = drv.withColumn("t", F.col("epoch").cast("double"))
    return chains.network_response(I.pairdiff(t), drv, ["row_key"], n_sigma=1e9, p_value=False)[0]
