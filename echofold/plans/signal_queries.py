"""Interferograms, unwrapping, blocks, sections, pass quality and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.operators import align, blocks, coherent, firn, interferogram, pairs, profiles, quality, unwrap
from echofold.operators.scan import Scan, ordered
from echofold.params import FirnParams, PairOptions
from echofold.plans import chains
from echofold.plans import inputs as I
from echofold.plans.pair_queries import FIRN_CTE, _interp
from echofold.plans.registry import query

# --- multilook and complex blocks -------------------------------------------

LOOK = I.PAIR_SAMPLES + """, xp AS (SELECT *, sec_re * ref_re + sec_im * ref_im AS xr, sec_im * ref_re - sec_re * ref_im AS xi, ref_re * ref_re + ref_im * ref_im AS pr, sec_re * sec_re + sec_im * sec_im AS ps FROM psamples),
l1 AS (SELECT line_id, ref_idx, sec_idx, col, bin, sum(xr) OVER w AS xr, sum(xi) OVER w AS xi, sum(pr) OVER w AS pr, sum(ps) OVER w AS ps, count(*) OVER w AS n FROM xp WINDOW w AS (PARTITION BY line_id, ref_idx, sec_idx, col ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
l2 AS (SELECT line_id, ref_idx, sec_idx, col, bin, sum(xr) OVER w AS xr, sum(xi) OVER w AS xi, sum(pr) OVER w AS pr, sum(ps) OVER w AS ps, sum(n) OVER w AS n FROM l1 WINDOW w AS (PARTITION BY line_id, ref_idx, sec_idx, bin ORDER BY col ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)),
ig AS (SELECT line_id, ref_idx, sec_idx, col, bin, xr / n AS re, xi / n AS im, least(sqrt(xr * xr + xi * xi) / sqrt(pr * ps), 1.0) AS coh FROM l2)"""

WIN, WIDTH = (3, 4), 20


def looked(t):
    """Tiled traces to interferograms: one exchange of traces, pairs and windows inside the tiles."""
    tiles = interferogram.tile_columns(I.slc(t), WIDTH, before=1, after=2)
    p = pairs.pair_samples(tiles, key=["line_id", "col_tile", "col"])
    ig = interferogram.multilook(interferogram.explode_samples(p), WIN, within=["col_tile"])
    return interferogram.drop_halo(ig, WIDTH)


@query("multilook", ints="line_id ref_idx sec_idx col bin", digits={"re": 8, "im": 8, "coh": 8}, sql=f"WITH {LOOK} SELECT * FROM ig")
def _(t):
    return looked(t)


CBLK = LOOK + ", " + I.REF_BINS + """, rf AS (SELECT g.line_id, g.ref_idx, g.sec_idx, g.col, g.re AS rr, g.im AS ri FROM ig g JOIN ref_bins b ON g.line_id = b.line_id AND g.col = b.col AND g.bin = b.ref_bin),
tn AS (SELECT g.line_id, g.ref_idx, g.sec_idx, g.col // 10 AS block, g.bin, CASE WHEN rr IS NOT NULL AND coh >= 0.3 THEN coh ELSE 0 END AS w, coalesce((re * rr + im * ri) / sqrt(rr * rr + ri * ri), 0) AS re, coalesce((im * rr - re * ri) / sqrt(rr * rr + ri * ri), 0) AS im,
  sqrt(re * re + im * im) AS m FROM ig g LEFT JOIN rf USING (line_id, ref_idx, sec_idx, col) WHERE bin IN (12, 20, 33, 50))"""


@query("complex_block_mean", ints="line_id ref_idx sec_idx block bin", digits={"re": 7, "im": 7, "w": 7}, sql=f"""
WITH {CBLK} SELECT line_id, ref_idx, sec_idx, block, bin, sum(re * w) / greatest(sum(w), 2.220446049250313e-16) AS re, sum(im * w) / greatest(sum(w), 2.220446049250313e-16) AS im, sum(w) AS w FROM tn GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return interferogram.complex_block_mean(looked(t), I.ref_bins(t), 10, 0.3, [12, 20, 33, 50], within=["col_tile"], tile_width=WIDTH)


@query("unit_phasor_block_mean", ints="line_id ref_idx sec_idx block bin", digits={"conc": 7}, sql=f"""
WITH {CBLK} SELECT line_id, ref_idx, sec_idx, block, bin, sqrt(pow(sum(re / m * w), 2) + pow(sum(im / m * w), 2)) / greatest(sum(w), 2.220446049250313e-16) AS conc FROM tn GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    d = interferogram.complex_block_mean(looked(t), I.ref_bins(t), 10, 0.3, [12, 20, 33, 50], unit=True, within=["col_tile"], tile_width=WIDTH)
    return d.withColumn("conc", F.hypot("re", "im"))


# --- unwrapping -------------------------------------------------------------

PHASES = """ph AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS bin, value / 10 AS phase, CASE WHEN event_type = 'error' THEN 0.1 ELSE 0.9 END AS coh FROM ev),
rb AS (SELECT *, CASE WHEN user_id % 9 = 4 THEN NULL ELSE user_id % 13 END AS ref_bin FROM ph),
st AS (SELECT *, coh >= 0.3 AND coalesce(lag(coh) OVER w >= 0.3, false) AS ok, phase - lag(phase) OVER w AS d FROM rb WINDOW w AS (PARTITION BY user_id ORDER BY bin)),
cs AS (SELECT *, sum(CASE WHEN ok THEN atan2(sin(d), cos(d)) ELSE 0 END) OVER w AS c, max(CASE WHEN ok OR bin <= ref_bin THEN bin END) OVER w AS good FROM st WINDOW w AS (PARTITION BY user_id ORDER BY bin)),
lv AS (SELECT user_id, min(bin) FILTER (bin > ref_bin AND bin - good > 3) - 4 AS last_bin, max(c) FILTER (bin = ref_bin) AS cr FROM cs GROUP BY 1),
un AS (SELECT cs.user_id, bin, ref_bin, last_bin, CASE WHEN coh >= 0.3 AND ref_bin IS NOT NULL AND (last_bin IS NULL OR bin <= last_bin) THEN -(c - cr) / (2 * pi()) END AS tau FROM cs JOIN lv USING (user_id))"""


def phases(t):
    d = ordered(I.events(t), "user_id", ["t", "event_id"], [Scan("_n", F.lit(1).cast("long"), "sum")])
    u = F.col("user_id")
    return d.select("user_id", (F.col("_n") - 1).alias("bin"), (F.col("value") / 10).alias("phase"),
                    F.when(F.col("event_type") == "error", 0.1).otherwise(0.9).alias("coh"), F.when(u % 9 != 4, u % 13).alias("ref_bin"))


@query("unwrap_phase", keys="valid", ints="user_id bin", digits={"dtau": 7, "dtau_above_ref": 7}, sql=f"""
WITH {I.EVENTS}, {PHASES} SELECT user_id, bin, coalesce(bin >= ref_bin, false) AND tau IS NOT NULL AS valid, CASE WHEN bin >= ref_bin THEN tau END AS dtau, CASE WHEN bin < ref_bin THEN tau END AS dtau_above_ref FROM un""")
def _(t):
    d = unwrap.unwrap_from_reference(phases(t), 1.0, ["user_id"], 0.3, 3, bounded=False)
    return d


@query("long_gap_truncation", ints="user_id last_bin", sql=f"WITH {I.EVENTS}, {PHASES} SELECT user_id, last_bin FROM lv")
def _(t):
    s = unwrap.steps(phases(t), ["user_id"], 0.3, bounded=False)
    return unwrap.last_valid_bin(s, ["user_id"], 3, bounded=False).groupBy("user_id").agg(F.max("last_bin").alias("last_bin"))


@query("reference_bin", ints="event_id ref_bin", sql="""
SELECT event_id, CASE WHEN p >= 0 AND p <= 199 THEN round(p) END AS ref_bin FROM (SELECT event_id, (CASE WHEN event_type <> 'error' THEN value END - 20.003) / 1.5 AS p FROM events)""")
def _(t):
    return t.events.select("event_id", unwrap.reference_bin(F.when(F.col("event_type") != "error", F.col("value")), F.lit(20.003), F.lit(1.5), F.lit(200)).alias("ref_bin"))


# --- blocks -----------------------------------------------------------------


@query("block_weighted_mean", ints="line_id block", digits={"coverage": 7, "mean": 8, "scatter": 8, "n_eff": 6, "std": 8, "coh": 7}, sql="""
WITH s AS (SELECT l_linenumber AS line_id, l_partkey // 50 AS block, l_tax * 10 AS d, l_discount * 10 AS coh, CASE WHEN l_discount >= 0.035 AND l_quantity < 46 THEN l_discount * 10 ELSE 0 END AS w FROM lineitem),
m AS (SELECT line_id, block, sum(w * d) / sum(w) AS mu, sum(w) AS sw, sum(w * w) AS sw2, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) / 220.0 AS coverage, avg(CASE WHEN w > 0 THEN coh END) AS mc FROM s GROUP BY 1, 2),
v AS (SELECT m.*, sd, greatest(sw * sw / sw2 / 3, 1) AS ne, coverage >= 0.5 AS keep FROM m JOIN (SELECT s.line_id, s.block, sqrt(sum(w * pow(d - mu, 2)) / any_value(sw)) AS sd FROM s JOIN m USING (line_id, block) GROUP BY 1, 2) USING (line_id, block))
SELECT line_id, block, coverage, CASE WHEN keep THEN mu END AS mean, CASE WHEN keep THEN sd END AS scatter, CASE WHEN keep THEN ne END AS n_eff, CASE WHEN keep THEN sd / sqrt(ne) END AS std, CASE WHEN keep THEN mc END AS coh FROM v""")
def _(t):
    d = t.lineitem.select(F.col("l_linenumber").alias("line_id"), F.col("l_partkey").alias("col"), F.when(F.col("l_quantity") < 46, F.col("l_tax") * 10).alias("dtau"), (F.col("l_discount") * 10).alias("coh"))
    return blocks.block_average(d, ["line_id"], F.floor(F.col("col") / 50), F.lit(220), coh_thr=0.35, min_coverage=0.5, cols_per_look=3, bounded=False)


@query("block_geolocation", ints="line_id pass_idx block", digits={"gps_time_s": 1, "ref_y": 6, "v": 7}, sql=f"""
WITH {I.TRACKS} SELECT line_id, pass_idx, col // 10 AS block, avg(gps_time_s) AS gps_time_s, avg(ref_y) AS ref_y, avg(v) AS v FROM tracks GROUP BY 1, 2, 3""")
def _(t):
    return blocks.block_geolocation(I.tracks(t), ["line_id", "pass_idx"], 10, ["gps_time_s", "ref_y", "v"])


NX = "nx AS (SELECT line_id, max(col) + 1 AS nx FROM samples GROUP BY 1)"
WINP = f"""{I.SAMPLES}, {NX}, wz AS (SELECT line_id, nx, least(12, nx) AS size, (nx - least(12, nx)) // 6 AS last FROM nx),
wn AS (SELECT line_id, w AS win, w * 6 AS s0, size FROM wz, range(200) AS r(w) WHERE w <= last UNION ALL SELECT line_id, last + 1, nx - size, size FROM wz WHERE last * 6 + size < nx),
pw AS (SELECT s.line_id, pass_idx, win, s0 + (size - 1) / 2.0 AS x_win, bin, avg(re * re + im * im) AS p FROM samples s JOIN wn ON s.line_id = wn.line_id AND s.col >= s0 AND s.col < s0 + size WHERE bin BETWEEN 5 AND 40 GROUP BY 1, 2, 3, 4, 5),
tp AS (SELECT line_id, pass_idx, win, x_win, bin - 5 AS i, (p - avg(p) OVER (PARTITION BY line_id, pass_idx, win)) * (0.5 - 0.5 * cos(2 * pi() * (bin - 5) / 35)) AS t FROM pw)"""


def _window_power(t):
    s = I.samples(t)
    return align.window_power(s, s.groupBy("line_id").agg((F.max("col") + 1).alias("nx")), 12, F.col("bin").between(5, 40))


@query("coarse_power_profile", ints="line_id pass_idx win i", digits={"x_win": 2, "t": 9}, sql=f"WITH {WINP} SELECT * FROM tp")
def _(t):
    return _window_power(t).select("line_id", "pass_idx", "win", "x_win", F.posexplode("p").alias("i", "t"))


SECTION = f"""{I.SAMPLES}, mp AS (SELECT line_id, col, bin, avg(re * re + im * im) AS p FROM samples WHERE bin BETWEEN 10 AND 50 GROUP BY 1, 2, 3),
mv AS (SELECT line_id, col, bin, 10 * log10(avg(p) OVER (PARTITION BY line_id, bin ORDER BY col ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) AS db FROM mp),
sec AS (SELECT line_id, col, bin, db - max(db) OVER (PARTITION BY line_id) AS db FROM mv)"""


def section(t):
    return profiles.mean_power_section(I.samples(t), 4, (10, 50))


@query("radargram", ints="line_id col bin", digits={"db": 6}, sql=f"WITH {SECTION} SELECT * FROM sec")
def _(t):
    return section(t)


@query("smooth_2d", ints="line_id col bin", digits={"sm": 6}, sql=f"""
WITH {SECTION}, a AS (SELECT line_id, col, bin, avg(db) OVER (PARTITION BY line_id, col ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM sec)
SELECT line_id, col, bin, avg(m) OVER (PARTITION BY line_id, bin ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM a""")
def _(t):
    return profiles.boxcar_mean(section(t), ["line_id"], [("bin", 5), ("col", 3)], "db", "sm")


TRACK = SECTION + """, z5 AS (SELECT line_id, col, bin * 2.0 AS z, avg(db) OVER (PARTITION BY line_id, col ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM sec),
im AS (SELECT line_id, dense_rank() OVER (PARTITION BY line_id ORDER BY col) - 1 AS pos, col, z, avg(m) OVER (PARTITION BY line_id, z ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM z5),
nc AS (SELECT line_id, max(pos) + 1 AS nc, (max(pos) + 2) // 2 - 1 AS seed FROM im GROUP BY 1),
o AS (SELECT im.line_id, pos, z FROM im JOIN nc ON nc.line_id = im.line_id AND pos = seed WHERE z BETWEEN 50 AND 80 QUALIFY row_number() OVER (PARTITION BY im.line_id ORDER BY v DESC, z) = 1),
fr AS (SELECT line_id, pos, z, 1 AS d FROM o UNION ALL SELECT f.line_id, f.pos + 1, arg_max(im.z, (v, -im.z)), 1 FROM fr f JOIN im ON im.line_id = f.line_id AND im.pos = f.pos + 1 AND im.z BETWEEN f.z - 4 AND f.z + 4 AND im.z >= 30 GROUP BY 1, 2),
bk AS (SELECT line_id, pos, z FROM o UNION ALL SELECT f.line_id, f.pos - 1, arg_max(im.z, (v, -im.z)) FROM bk f JOIN im ON im.line_id = f.line_id AND im.pos = f.pos - 1 AND im.z BETWEEN f.z - 4 AND f.z + 4 AND im.z >= 30 GROUP BY 1, 2),
pt AS (SELECT line_id, pos, z FROM fr UNION SELECT line_id, pos, z FROM bk),
al AS (SELECT c.line_id, c.col, c.pos, nc, z FROM (SELECT DISTINCT line_id, col, pos FROM im) c JOIN nc ON nc.line_id = c.line_id LEFT JOIN pt ON pt.line_id = c.line_id AND pt.pos = c.pos),
md AS (SELECT *, median(z) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM al)"""


@query("track_layer", ints="line_id col", digits={"depth": 3}, sql=f"""
WITH RECURSIVE {TRACK} SELECT line_id, col, CASE WHEN z IS NULL OR pos < least(4, nc // 2) OR pos >= nc - least(4, nc // 2) THEN z ELSE m END AS depth FROM md""")
def _(t):
    s = section(t).select("line_id", "col", (F.col("bin") * 2.0).alias("z"), "db")
    return profiles.track_layer(s, window=(50.0, 80.0), step=4.0, zmin=30.0, smooth=9)


MONTHLY = "mo AS (SELECT l_suppkey AS row_key, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS k, avg(l_extendedprice) / 9973 AS v, avg(l_tax) * 10 AS s FROM lineitem GROUP BY 1, 2)"


def monthly(t):
    k = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("row_key"), k.alias("k")).agg((F.avg("l_extendedprice") / 9973).alias("v"), (F.avg("l_tax") * 10).alias("s"))


@query("moving_median", ints="row_key k", digits={"med": 9}, sql=f"""
WITH {MONTHLY}, a AS (SELECT row_key, k, v, median(v) OVER (PARTITION BY row_key ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m, row_number() OVER (PARTITION BY row_key ORDER BY k) AS i, count(*) OVER (PARTITION BY row_key) AS n FROM mo)
SELECT row_key, k, CASE WHEN i <= least(4, n // 2) OR i > n - least(4, n // 2) THEN v ELSE m END AS med FROM a""")
def _(t):
    return profiles.moving_median(monthly(t), ["row_key"], "k", "v", 9)


@query("detrend_running_mean", ints="row_key k", digits={"detrended": 7}, sql=f"""
WITH {MONTHLY} SELECT row_key, k, v - avg(v) OVER (PARTITION BY row_key ORDER BY k RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS detrended FROM mo""")
def _(t):
    return profiles.detrend_running_mean(monthly(t), ["row_key"], "k", "v", 41)


@query("cumulative_trapezoid", ints="row_key k", digits={"integral": 6}, sql=f"""
WITH {MONTHLY} SELECT row_key, k, sum(a) OVER (PARTITION BY row_key ORDER BY k) AS integral FROM (SELECT row_key, k, coalesce((k - lag(k) OVER w) * (v + lag(v) OVER w) / 2, 0) AS a FROM mo WINDOW w AS (PARTITION BY row_key ORDER BY k))""")
def _(t):
    return firn.running_trapezoid(monthly(t), "k", "v", ["row_key"])


@query("thin_columns", ints="event_id", sql="""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE (i - 1) % greatest(1, CAST(round(n / 400.0) AS BIGINT)) = 0""")
def _(t):
    return profiles.thin_columns(t.events.select("event_type", "event_id"), ["event_type"], "event_id")


# --- pass quality -----------------------------------------------------------


@query("pass_marginals", keys="line_id", ints="pass_idx", digits={"q_med": 9, "frac_applied": 6}, sql=f"""
WITH {I.PAIRDIFF}, bth AS (SELECT row_key AS line_id, ref_idx AS pass_idx, d AS q, n FROM pairdiff UNION ALL SELECT row_key, sec_idx, d, n FROM pairdiff)
SELECT line_id, pass_idx, median(q) AS q_med, avg(CASE WHEN n >= 20 THEN 1.0 ELSE 0.0 END) AS frac_applied FROM bth GROUP BY 1, 2""")
def _(t):
    p = I.pairdiff(t).select(F.col("row_key").alias("line_id"), "ref_idx", "sec_idx", F.col("d").alias("q"), (F.col("n") >= 20).alias("applied"))
    return quality.pass_marginals(p, ["q"], "applied")


@query("surface_metrics", ints="line_id pass_idx", digits={"coverage": 6, "surf_db": 6, "width_bins": 2, "snr_db": 6}, sql=f"""
WITH {I.SAMPLES}, {I.REF_BINS}, sg AS (SELECT s.*, b.ref_bin, b.ref_bin IS NOT NULL AND ref_bin >= 10 AND ref_bin < 22 AS good, re * re + im * im AS p FROM samples s JOIN ref_bins b USING (line_id, col)),
cv AS (SELECT line_id, pass_idx, avg(CASE WHEN good THEN 1.0 ELSE 0 END) AS coverage FROM sg GROUP BY 1, 2),
nr AS (SELECT *, bin BETWEEN ref_bin - 6 AND ref_bin + 6 AS near FROM sg WHERE good),
pk AS (SELECT line_id, pass_idx, col, max(p) AS pm, arg_max(bin, p) AS at FROM nr WHERE near GROUP BY 1, 2, 3),
cc AS (SELECT n.line_id, n.pass_idx, n.col, any_value(pm) AS pm, coalesce(min(bin) FILTER (near AND p < pm / 4 AND bin > k.at) - 1, max(bin) FILTER (near)) - coalesce(max(bin) FILTER (near AND p < pm / 4 AND bin < k.at) + 1, min(bin) FILTER (near)) + 1 AS width,
  median(p) FILTER (bin <= greatest(1, ref_bin - 8)) AS nf, median(p) FILTER (bin IN (40, 45, 50)) AS cp FROM nr n JOIN pk k USING (line_id, pass_idx, col) GROUP BY 1, 2, 3)
SELECT line_id, pass_idx, coverage, surf_db, width_bins, snr_db FROM cv LEFT JOIN (SELECT line_id, pass_idx, 10 * log10(median(pm)) AS surf_db, median(width) AS width_bins, 10 * log10(median(cp) / median(nf)) AS snr_db FROM cc GROUP BY 1, 2) USING (line_id, pass_idx)""")
def _(t):
    return quality.surface_metrics(I.samples(t), I.ref_bins(t), 28, [40, 45, 50], half=6, guard=8, edge=(10, 5))


MAIN = I.SAMPLES + """, mx AS (SELECT b.line_id, b.pass_idx AS sec_idx, b.col, b.bin, b.re * a.re + b.im * a.im AS xr, b.im * a.re - b.re * a.im AS xi, b.re * b.re + b.im * b.im AS pk, a.re * a.re + a.im * a.im AS pm
  FROM samples a JOIN samples b ON a.line_id = b.line_id AND a.col = b.col AND a.bin = b.bin AND a.pass_idx = 0 AND b.pass_idx <> 0)"""


@query("gain_coherence_vs_main", ints="line_id sec_idx", digits={"gain_db": 6, "surface_db": 6, "coherence_db": 6, "phase_deg": 5, "wander_deg": 5}, sql=f"""
WITH {MAIN}, c AS (SELECT line_id, sec_idx, col, sum(xr) FILTER (bin BETWEEN 8 AND 12) AS sr, sum(xi) FILTER (bin BETWEEN 8 AND 12) AS si FROM mx GROUP BY 1, 2, 3),
u AS (SELECT line_id, sec_idx, sqrt(pow(avg(sr / sqrt(sr * sr + si * si)), 2) + pow(avg(si / sqrt(sr * sr + si * si)), 2)) AS r FROM c GROUP BY 1, 2),
g AS (SELECT line_id, sec_idx, sum(xr) AS ar, sum(xi) AS ai, sum(xr) FILTER (bin BETWEEN 20 AND 60) AS cr, sum(xi) FILTER (bin BETWEEN 20 AND 60) AS ci, sum(pk) FILTER (bin BETWEEN 20 AND 60) AS ck, sum(pm) FILTER (bin BETWEEN 20 AND 60) AS cm,
  sum(pk) FILTER (bin BETWEEN 8 AND 12) AS sk, sum(pm) FILTER (bin BETWEEN 8 AND 12) AS sm FROM mx GROUP BY 1, 2)
SELECT line_id, sec_idx, 10 * log10(ck / cm) AS gain_db, 10 * log10(sk / sm) AS surface_db, 20 * log10(sqrt(cr * cr + ci * ci) / sqrt(ck * cm)) AS coherence_db, degrees(atan2(ai, ar)) AS phase_deg, degrees(sqrt(-2 * ln(r))) AS wander_deg FROM g JOIN u USING (line_id, sec_idx)""")
def _(t):
    return quality.relative_to_main(I.main_samples(t), (20, 60), (8, 12))


@query("upper_column_phase", ints="line_id sec_idx", digits={"phase_deg": 5}, sql=f"""
WITH {MAIN}, {I.REF_BINS}, c AS (SELECT line_id, sec_idx, col, sum(xr) FILTER (abs(bin - ref_bin) <= 2) AS sr, sum(xi) FILTER (abs(bin - ref_bin) <= 2) AS si, sum(xr) FILTER (bin BETWEEN ref_bin + 10 AND ref_bin + 42) AS cr,
  sum(xi) FILTER (bin BETWEEN ref_bin + 10 AND ref_bin + 42) AS ci FROM mx JOIN ref_bins USING (line_id, col) WHERE ref_bin >= 2 AND ref_bin + 42 < 64 GROUP BY 1, 2, 3)
SELECT line_id, sec_idx, degrees(atan2(sum((ci * sr - cr * si) / sqrt(sr * sr + si * si)), sum((cr * sr + ci * si) / sqrt(sr * sr + si * si)))) AS phase_deg FROM c GROUP BY 1, 2""")
def _(t):
    return quality.upper_column_phase(I.main_samples(t), I.ref_bins(t), 64, 2, (10, 42))


@query("pass_equalization", ints="line_id pass_idx", digits={"gain_db": 6, "phase_deg": 5}, sql=f"""
WITH {MAIN}, p AS (SELECT line_id, pass_idx, 10 * log10(avg(re * re + im * im)) AS d FROM samples WHERE bin BETWEEN 20 AND 60 GROUP BY 1, 2), x AS (SELECT line_id, sec_idx AS pass_idx, degrees(atan2(avg(xi), avg(xr))) AS ph FROM mx GROUP BY 1, 2)
SELECT line_id, pass_idx, d - avg(d) OVER (PARTITION BY line_id) AS gain_db, coalesce(ph, 0) AS phase_deg FROM p LEFT JOIN x USING (line_id, pass_idx)""")
def _(t):
    return quality.pass_equalization(I.samples(t), I.main_samples(t), (20, 60))


DAILY = "dl AS (SELECT event_type, CAST(floor((t - 1704067200) / 86400) AS INTEGER) AS day, avg(value) AS v, count(*) AS n, max(value) AS m FROM ev GROUP BY 1, 2)"


def daily(t):
    return I.events(t).groupBy("event_type", F.floor((F.col("t") - 1704067200) / 86400).alias("day")).agg(
        F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"), F.max("value").alias("m"))


@query("robust_flags", keys="event_type flag why", ints="day", sql=f"""
WITH {I.EVENTS}, {DAILY}, md AS (SELECT event_type, median(v) AS mv, median(n) AS mn, median(m) AS mm FROM dl GROUP BY 1),
sd AS (SELECT event_type, any_value(mv) AS mv, any_value(mn) AS mn, any_value(mm) AS mm, 1.4826 * median(abs(v - mv)) AS sv, 1.4826 * median(abs(n - mn)) AS sn, 1.4826 * median(abs(m - mm)) AS sm FROM dl JOIN md USING (event_type) GROUP BY 1),
z AS (SELECT event_type, day, v, n, m, -(v - mv) / sv AS zv, -(n - mn) / sn AS zn, (m - mm) / sm AS zm FROM dl JOIN sd USING (event_type)),
w AS (SELECT event_type, day, concat_ws(' ', CASE WHEN zv > 1.2 AND v < 49.0003 THEN printf('value(z%+.1f)', zv) END, CASE WHEN zn > 1.2 THEN printf('count(z%+.1f)', zn) END, CASE WHEN zm > 1.2 AND m > 200.003 THEN printf('peak(z%+.1f)', zm) END) AS why FROM z)
SELECT event_type, day, why <> '' AS flag, why FROM w""")
def _(t):
    rules = [("value", "v", -1, 49.0003), ("count", "n", -1, None), ("peak", "m", 1, 200.003)]
    return quality.robust_flags(daily(t), rules, ["event_type"], ["day"], z_flag=1.2)


@query("calibration_flags", keys="event_type flag why", ints="day", sql=f"""
WITH {I.EVENTS}, {DAILY}, w AS (SELECT event_type, day, concat_ws(' ', CASE WHEN abs(v - 50) > 5 THEN 'gain' END, CASE WHEN m > 250.003 THEN 'drift' END) AS why FROM dl) SELECT event_type, day, why <> '' AS flag, why FROM w""")
def _(t):
    return quality.limit_flags(daily(t), {"gain": F.abs(F.col("v") - 50) > 5, "drift": F.col("m") > 250.003}, ["event_type", "day"])


@query("window_spread", keys="event_type", ints="n", digits={"spread": 4, "r": 6, "slope": 6}, sql=f"""
WITH {I.EVENTS}, o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM ev),
q AS (SELECT event_type, any_value(n) AS n, max(value) FILTER (k = floor(n * 0.05 - 0.5)) AS a, max(value) FILTER (k = ceil(n * 0.05 - 0.5)) AS b, max(value) FILTER (k = floor(n * 0.95 - 0.5)) AS c, max(value) FILTER (k = ceil(n * 0.95 - 0.5)) AS d FROM o GROUP BY 1),
r AS (SELECT event_type, corr(x, value) AS r, regr_slope(value, x) AS slope FROM (SELECT event_type, value, (t - 1704067200) / 86400 AS x FROM ev) GROUP BY 1)
SELECT event_type, n, c + (n * 0.95 - 0.5 - floor(n * 0.95 - 0.5)) * (d - c) - a - (n * 0.05 - 0.5 - floor(n * 0.05 - 0.5)) * (b - a) AS spread, r, slope FROM q JOIN r USING (event_type)""")
def _(t):
    return quality.window_spread(I.events(t).withColumn("x", (F.col("t") - 1704067200) / 86400), ["event_type"], "value", "x")


SHIFT = MAIN.split(", mx AS")[0] + """, xc AS (SELECT b.line_id, b.pass_idx AS sec_idx, l AS lag, sum(b.re * a.re + b.im * a.im) AS r, sum(b.im * a.re - b.re * a.im) AS i FROM samples a, range(-7, 8) AS q(l) JOIN samples b ON a.line_id = b.line_id AND a.col = b.col
  AND b.bin = a.bin + l AND b.pass_idx <> 0 WHERE a.pass_idx = 0 AND a.bin BETWEEN 10 AND 50 GROUP BY 1, 2, 3),
gv AS (SELECT line_id, sec_idx, g, -0.4 + 0.1 * g AS s, sqrt(pow(sum(r * snc), 2) + pow(sum(i * snc), 2)) AS v FROM (SELECT *, CASE WHEN abs(lag - (-0.4 + 0.1 * g)) < 1e-12 THEN 1 ELSE sin(pi() * (lag - (-0.4 + 0.1 * g))) / (pi() * (lag - (-0.4 + 0.1 * g))) END AS snc
  FROM xc, range(9) AS h(g) WHERE abs(lag) <= 6) GROUP BY line_id, sec_idx, g),
nb AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM gv WINDOW w AS (PARTITION BY line_id, sec_idx ORDER BY g))"""


@query("coherent_shift_grid", ints="line_id sec_idx", digits={"shift": 6, "peak": 6}, sql=f"""
WITH {SHIFT} SELECT line_id, sec_idx, s + 0.1 * 0.5 * (a - b) / (a - 2 * v + b) AS shift, v AS peak FROM nb QUALIFY row_number() OVER (PARTITION BY line_id, sec_idx ORDER BY v DESC, g) = 1""")
def _(t):
    return quality.coherent_shift(I.main_samples(t), [-0.4 + 0.1 * k for k in range(9)], (10, 50), ["line_id", "sec_idx"])


@query("shift_injection", ints="line_id sec_idx", digits={"recovery": 5})
def _(t):
    # The pass is made coherent with the main one, so that there is a shift to find.
    d = I.main_samples(t).withColumn("sec_re", F.col("ref_re") + 0.4 * F.col("sec_re")).withColumn("sec_im", F.col("ref_im") + 0.4 * F.col("sec_im"))
    return quality.shift_injection(d, [-0.4 + 0.02 * k for k in range(41)], (10, 50), ["line_id", "sec_idx"])


@query("layer_delay", ints="line_id sec_idx", digits={"delay": 5})
def _(t):
    d = I.main_samples(t).where("bin between 4 and 59").groupBy("line_id", "sec_idx", "bin").agg(
        F.avg(F.col("ref_re") ** 2 + F.col("ref_im") ** 2).alias("a"), F.avg(F.col("sec_re") ** 2 + F.col("sec_im") ** 2).alias("b"))
    packed = d.groupBy("line_id", "sec_idx").agg(F.array_sort(F.collect_list(F.struct("bin", "a", "b"))).alias("_p"))
    packed = packed.select("line_id", "sec_idx", F.transform("_p", lambda e: e["a"]).alias("p_ref"), F.transform("_p", lambda e: e["b"]).alias("p_sec"))
    return quality.layer_delay(packed, ["line_id", "sec_idx"])


# --- alignment --------------------------------------------------------------


def _shifts(t):
    p = pairs.pair_samples(_window_power(t), key=["line_id", "win", "x_win"], values=["p"])
    return align.window_shift(p, max_lag=3.0, upsample=16, min_quality=0.15)


# The correlation at whole lags, brought to lags of a sixteenth by the kernel of 128 points without its highest frequency.
SHIFTS = WINP + """, wc AS (SELECT a.line_id, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx, a.win, a.x_win, b.i - a.i AS m, sum(a.t * b.t) AS r FROM tp a JOIN tp b ON a.line_id = b.line_id AND a.win = b.win AND a.pass_idx < b.pass_idx GROUP BY 1, 2, 3, 4, 5, 6),
ee AS (SELECT line_id, pass_idx, win, sum(t * t) AS e FROM tp GROUP BY 1, 2, 3),
kr AS (SELECT q, q / 16.0 AS lag, m, CASE WHEN q = 16 * m THEN 127 / 128.0 ELSE sin(pi() * (q / 16.0 - m) * 127 / 128) / (128 * sin(pi() * (q / 16.0 - m) / 128)) END AS w FROM range(-128, 129) r(q), range(-35, 36) s(m)),
cc AS (SELECT wc.line_id, ref_idx, sec_idx, wc.win, x_win, q, lag, sum(r * w) / sqrt(any_value(a.e) * any_value(b.e)) AS c FROM wc JOIN kr USING (m) JOIN ee a ON a.line_id = wc.line_id AND a.win = wc.win AND a.pass_idx = ref_idx
  JOIN ee b ON b.line_id = wc.line_id AND b.win = wc.win AND b.pass_idx = sec_idx GROUP BY 1, 2, 3, 4, 5, 6, 7),
tk AS (SELECT line_id, ref_idx, sec_idx, win, lag AS shift, c AS quality FROM cc WHERE abs(lag) <= 3 QUALIFY row_number() OVER (PARTITION BY line_id, ref_idx, sec_idx, win ORDER BY c DESC, q) = 1),
lm AS (SELECT *, lag(c) OVER w AS c0, lead(c) OVER w AS c1 FROM cc WINDOW w AS (PARTITION BY line_id, ref_idx, sec_idx, win ORDER BY q)),
sl AS (SELECT line_id, ref_idx, sec_idx, win, max(c) AS side FROM lm JOIN tk USING (line_id, ref_idx, sec_idx, win) WHERE c > c0 AND c > c1 AND abs(lag - shift) > 0.5 GROUP BY 1, 2, 3, 4),
sh AS (SELECT tk.*, x.x_win, CASE WHEN quality > 0 THEN side / quality END AS sidelobe, quality >= 0.15 AND abs(shift) < 3 - 1 / 16.0 AS accepted FROM tk JOIN (SELECT DISTINCT line_id, win, x_win FROM tp) x USING (line_id, win) LEFT JOIN sl USING (line_id, ref_idx, sec_idx, win))"""
DELAYS = SHIFTS + """, ac AS (SELECT line_id, ref_idx, sec_idx, x_win AS x, shift * 3.0 AS v, lead(x_win) OVER w AS x1, lead(shift * 3.0) OVER w AS v1, row_number() OVER w AS rn FROM sh WHERE accepted WINDOW w AS (PARTITION BY line_id, ref_idx, sec_idx ORDER BY x_win)),
pc AS (SELECT DISTINCT a.line_id, a.pass_idx AS ref_idx, b.pass_idx AS sec_idx, c.col FROM (SELECT DISTINCT line_id, pass_idx FROM samples) a JOIN (SELECT DISTINCT line_id, pass_idx FROM samples) b ON a.line_id = b.line_id AND a.pass_idx < b.pass_idx JOIN (SELECT DISTINCT line_id, col FROM samples) c ON c.line_id = a.line_id),
dl AS (SELECT p.*, CASE WHEN t.x IS NULL THEN h.v WHEN t.x1 IS NULL OR t.x = p.col THEN t.v ELSE t.v + (p.col - t.x) * (t.v1 - t.v) / (t.x1 - t.x) END AS delay_ns
  FROM pc p ASOF LEFT JOIN ac t ON p.line_id = t.line_id AND p.ref_idx = t.ref_idx AND p.sec_idx = t.sec_idx AND p.col >= t.x LEFT JOIN ac h ON h.line_id = p.line_id AND h.ref_idx = p.ref_idx AND h.sec_idx = p.sec_idx AND h.rn = 1)"""


@query("window_shift", keys="accepted", ints="line_id ref_idx sec_idx win", digits={"shift": 5, "quality": 5, "sidelobe": 5}, sql=f"WITH {SHIFTS} SELECT * FROM sh")
def _(t):
    return _shifts(t)


@query("alignment_summary", keys="coalign_applied", ints="line_id ref_idx sec_idx n_win n_ok", digits={"quality": 5}, sql=f"""
WITH {SHIFTS} SELECT line_id, ref_idx, sec_idx, count(*) AS n_win, count(*) FILTER (accepted) AS n_ok, coalesce(median(quality) FILTER (accepted), max(quality)) AS quality, count(*) FILTER (accepted) > 0 AS coalign_applied FROM sh GROUP BY 1, 2, 3""")
def _(t):
    return align.alignment_summary(_shifts(t))


def _delays(t):
    cols = pairs.make_pairs(I.slc(t).select("line_id", "pass_idx").distinct(), "all").join(I.slc(t).select("line_id", "col").distinct(), "line_id")
    return align.shift_profile(_shifts(t), cols, 3.0e-9)


@query("shift_profile", ints="line_id ref_idx sec_idx col", digits={"delay_ns": 9}, sql=f"WITH {DELAYS} SELECT * FROM dl")
def _(t):
    return _delays(t).withColumn("delay_ns", F.col("delay") * 1e9)


# The first sample of a delayed trace: every sample turned by the phase of each of 64 frequencies, then by the carrier.
@query("apply_delay", ints="line_id ref_idx sec_idx col", digits={"power": 6, "first_re": 6}, sql=f"""
WITH {DELAYS}, kd AS (SELECT d.line_id, d.ref_idx, d.sec_idx, d.col, d.delay_ns, s.bin, s.re, s.im FROM dl d JOIN samples s ON s.line_id = d.line_id AND s.pass_idx = d.sec_idx AND s.col = d.col
  WHERE EXISTS (SELECT 1 FROM samples r WHERE r.line_id = d.line_id AND r.pass_idx = d.ref_idx AND r.col = d.col)),
ph AS (SELECT line_id, ref_idx, sec_idx, col, bin, re, im, delay_ns, sum(cos(2 * pi() * (k * (delay_ns / 3 - bin) / 64 + 0.75 * delay_ns))) / 64 AS a, sum(sin(2 * pi() * (k * (delay_ns / 3 - bin) / 64 + 0.75 * delay_ns))) / 64 AS b
  FROM kd, range(-32, 32) AS r(k) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)
SELECT line_id, ref_idx, sec_idx, col, sum(re * re + im * im) AS power, CASE WHEN any_value(delay_ns) IS NULL THEN max(CASE WHEN bin = 0 THEN re END) ELSE sum(re * a - im * b) END AS first_re FROM ph GROUP BY 1, 2, 3, 4""")
def _(t):
    p = pairs.pair_samples(I.slc(t)).select("line_id", "ref_idx", "sec_idx", "col", F.col("sec_re").alias("re"), F.col("sec_im").alias("im"))
    d = align.apply_delay(p.join(_delays(t), ["line_id", "ref_idx", "sec_idx", "col"]), 7.5e8, 3.0e-9)
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda acc, v: acc + v)
    return d.select("line_id", "ref_idx", "sec_idx", "col", power.alias("power"), F.col("re")[0].alias("first_re"))


# --- the chains over traces -------------------------------------------------

OPT = PairOptions(window=WIN, coherence_threshold=0.2, max_gap_bins=6, block_size=WIDTH, min_coverage=0.05, cols_per_look=4, bins_per_look=3,
                  fit_top=0.0, min_samples=6, min_fit_range=5.0)


def _axis(t):
    ax = I.slc(t).select("line_id").distinct().select("line_id", F.lit(7.5e8).alias("fc"), F.lit(0.0).alias("t0"), F.lit(3.3e-9).alias("dt"), F.lit(64).alias("nt"))
    return ax, I.ref_bins(t).select("line_id", "col", (F.col("ref_bin") * 3.3e-9).alias("surface_twtt_s"))


def _chain(t):
    axis, surface = _axis(t)
    want = pairs.make_pairs(I.slc(t).select("line_id", "pass_idx").distinct(), "all")
    dt = want.join(I.slc(t).select("line_id", "col").distinct(), "line_id").withColumn("dt_s", (F.col("sec_idx") - F.col("ref_idx")) * 86400.0 + F.col("col"))
    return chains.pair_profiles(I.slc(t), axis, surface, want, dt, OPT, FirnParams(max_depth=60.0, nz=601))


CHAIN = LOOK + ", " + I.REF_BINS + ", " + FIRN_CTE + f""", u0 AS (SELECT g.*, atan2(g.im, g.re) AS ph, b.ref_bin FROM ig g JOIN ref_bins b ON g.line_id = b.line_id AND g.col = b.col),
u1 AS (SELECT *, coh >= 0.2 AND coalesce(lag(coh) OVER w >= 0.2, false) AS ok, ph - lag(ph) OVER w AS d FROM u0 WINDOW w AS (PARTITION BY line_id, ref_idx, sec_idx, col ORDER BY bin)),
u2 AS (SELECT *, sum(CASE WHEN ok THEN atan2(sin(d), cos(d)) ELSE 0 END) OVER w AS c, max(CASE WHEN ok OR bin <= ref_bin THEN bin END) OVER w AS good FROM u1 WINDOW w AS (PARTITION BY line_id, ref_idx, sec_idx, col ORDER BY bin)),
lv AS (SELECT line_id, ref_idx, sec_idx, col, min(bin) FILTER (bin > ref_bin AND bin - good > 6) - 7 AS last_bin, max(c) FILTER (bin = ref_bin) AS cr FROM u2 GROUP BY 1, 2, 3, 4),
un AS (SELECT u2.*, CASE WHEN coh >= 0.2 AND bin >= ref_bin AND (last_bin IS NULL OR bin <= last_bin) THEN -(c - cr) / (2 * pi() * 7.5e8) END AS tau FROM u2 JOIN lv USING (line_id, ref_idx, sec_idx, col)),
sw AS (SELECT line_id, ref_idx, sec_idx, col // 20 AS block, bin, coalesce(tau, 0) AS tau, CASE WHEN tau IS NOT NULL THEN coh ELSE 0 END AS w FROM un),
geo AS (SELECT line_id, col // 20 AS block, count(*) AS span, avg(ref_bin * 3.3e-9) AS s FROM ref_bins GROUP BY 1, 2),
bm AS (SELECT s.line_id, ref_idx, sec_idx, s.block, bin, CASE WHEN sum(w) > 0 THEN sum(w * tau) / sum(w) END AS mean, sum(w) AS sw, greatest(pow(sum(w), 2) / greatest(sum(w * w), 2.220446049250313e-16) / 4, 1) AS ne, count(*) FILTER (w > 0) / any_value(span)::DOUBLE AS coverage, 3.3e-9 * bin - any_value(g.s) AS twtt
  FROM sw s JOIN geo g ON s.line_id = g.line_id AND s.block = g.block GROUP BY s.line_id, ref_idx, sec_idx, s.block, bin),
dep AS ({_interp('bm', 'twtt', 'firn', 'twtt', 'd', 'depth')}),
loc AS ({_interp('dep', 'depth', 'firn', 'd', 'n', 'n_local')})"""


@query("pair_chain", ints="line_id ref_idx sec_idx block bin", digits={"depth": 4, "dh": 6, "n_eff": 4, "coverage": 5}, sql=f"""
WITH {CHAIN} SELECT line_id, ref_idx, sec_idx, block, bin, depth, CASE WHEN sw > 0 AND coverage >= 0.05 THEN mean * (299792458.0 / 2) / n_local END AS dh, CASE WHEN sw > 0 AND coverage >= 0.05 THEN ne END AS n_eff, coverage FROM loc""")
def _(t):
    return _chain(t)


@query("pair_strain", keys="short", ints="line_id ref_idx sec_idx block n", digits={"s1": 5, "s2": 5, "strain_mean": 5})
def _(t):
    return chains.pair_strain(_chain(t), OPT)


@query("coherent_stack", ints="line_id block bin n", digits={"a": 4, "f": 5, "a_sd": 5})
def _(t):
    drv = I.samples(t).groupBy("line_id", "pass_idx").agg((F.sum("re") / F.count(F.lit(1)) * 100).alias("tide_m"))
    grid = coherent.grid_of(-2.0, 2.0, 81)
    return chains.coherent_stack(looked(t), I.ref_bins(t), drv, [12, 20, 33, 50], F.lit(1.0), 10, grid, 0.2, min_pairs=3, within=["col_tile"], tile_width=WIDTH)
