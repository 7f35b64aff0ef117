"""Ties that rounding must not decide."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from echofold.functions import columns as C
from echofold.operators import matching
from echofold.plans import catalog
from echofold.sources import tables as S


def test_equal_latitudes_within_rounding_are_a_tie(spark):
    rows = [(1, 1, 500.0, 0.1 + 0.2, 1.0), (1, 2, 1000.0, 0.25, 2.0), (1, 3, 1500.0, 0.3, 3.0),
            (2, 1, 500.0, 0.3, 1.0), (2, 2, 1000.0, 0.25, 2.0), (2, 3, 1500.0, 0.1 + 0.2, 3.0)]
    d = spark.createDataFrame(rows, "line_id long, block int, xb double, lat double, a double")
    got = {(r.line_id, r.block): r.x_sea for r in matching.orient_seaward(d, ["line_id"], strict=False).collect()}
    assert got == {(i, b): 1500.0 - 500.0 * b for i in (1, 2) for b in (1, 2, 3)}


def test_mean_time_on_the_edge_does_not_depend_on_the_order(spark):
    t = [97.2, 101.17, 95.57, 93.57, 97.95, 101.62, 102.42]  # mean 98.5; added in this order, a little less
    rows = [(1, 1, 1, v) for v in t]
    d = spark.createDataFrame(rows, "product int, day_seg int, pass_idx int, gps_time_s double").coalesce(1)
    assert [r.t_key for r in S.dedupe_passes(d).collect()] == [99]


def test_gaps_equal_within_rounding_go_to_the_lower_position(spark):
    x = [(k, 100.0 + k + 0.05) for k in range(40)]
    a = spark.createDataFrame(x, "id long, x double").withColumn("x", F.round("x", 2))
    b = spark.createDataFrame([(2 * k + s, round(v + (0.02, -0.02)[s], 2)) for k, v in x for s in (0, 1)], "cid long, x double")
    got = {r.id: r.b.cid for r in matching.nearest_match(a, b, "x", 1.0, id_b="cid").collect()}
    assert got == {k: 2 * k + 1 for k, _ in x}


def test_flags_do_not_depend_on_the_split_of_the_table(spark, tmp_path):
    # Means of tax on 0.035 but for rounding: added row by row just above, added file by file not, and the other way round.
    row = {"l_suppkey": 1, "l_quantity": 1.0, "l_discount": 0.06}
    taxes = {1: [[0.0, 0.0, 0.02], [0.03, 0.08, 0.08]], 2: [[0.0, 0.0, 0.01], [0.06, 0.08, 0.06]], 3: [[0.06], [0.07]]}
    (tmp_path / "lineitem.parquet").mkdir()
    for k in (0, 1):
        rows = [row | {"l_shipdate": dt.datetime(1994 + p, 3, 1), "l_tax": x, "l_extendedprice": 1.0} for p, t in taxes.items() for x in t[k]]
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLE["drop_flagged"]).fetchall())
    assert want == [(1, 1, 3)]
    assert sorted(map(tuple, catalog.QUERIES["drop_flagged"](spark, str(tmp_path)).collect())) == want


def test_mean_in_order_skips_missing_values(spark):
    d = spark.createDataFrame([(1, [0.1, None, 0.2, 0.3]), (2, [None]), (3, [])], "k int, v array<double>")
    got = {r.k: r.m for r in d.select("k", C.mean_in_order(F.col("v")).alias("m")).collect()}
    assert got == {1: (0.1 + 0.2 + 0.3) / 3, 2: None, 3: None}


def test_surface_bin_is_at_depth_zero_whatever_the_order_of_its_mean(spark, rng, tmp_path):
    # 15 lines with surface bins 8 to 18 in columns 0 to 10, none in column 5: their mean is bin 13 but for rounding.
    ids = [400 * line + 4 * col + p for line in range(15) for col in range(11) for p in (0, 1)]
    rows = [{"vec_id": i, "embedding": rng.normal(size=64).astype("float32").tolist()} for i in ids]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])), tmp_path / "embeddings.parquet")
    got = {r.line_id: r.depth for r in catalog.QUERIES["pair_chain"](spark, str(tmp_path)).where("bin = 13").collect()}
    assert got == {line: 0.0 for line in range(15)}
