"""Text readers, the station table, incremental appends and build comparison."""

import pytest
from pyspark.sql import functions as F

from echofold.sources import tables as S
from echofold.streaming.incremental import append_missing


def test_text_readers(spark, tmp_path):
    p = tmp_path / "tide.csv"
    p.write_text("datenum,iso,tide_m\n719530.0,1970-01-02,0.5\n719530.5,x,NaN\n719531,x,-0.25\n")
    assert [(r.ts_s, r.tide_m) for r in S.read_tide(spark, str(p)).orderBy("ts_s").collect()] == [(86400.0, 0.5), (172800.0, -0.25)]
    p = tmp_path / "sites.csv"
    p.write_text("# note\ndatenum,iso,S1,S2\n719529,x,1.5,\n719530,x,nan,2\n")
    got = {(r.site, r.ts_s): r.tide_m for r in S.read_tide_sites(spark, str(p)).collect()}
    assert got == {("S1", 0.0): 1.5, ("S2", 0.0): None, ("S1", 86400.0): None, ("S2", 86400.0): 2.0}
    p = tmp_path / "xy.txt"
    p.write_text("# c\n1.5\t2.5\tS4\n 3  4  S5 \n")
    assert sorted(r.site for r in S.read_stations(spark, str(p)).collect()) == ["S4", "S5"]
    assert S.read_stations(spark, str(tmp_path / "absent.txt")).count() == 0
    p = tmp_path / "pairs.csv"
    p.write_text("site,t1,dt,v\nA,2022-01-01T00:00:00,0.02,1.5\nA,2022-01-01 00:30:00,0.5,1\nA,2022-01-01 01:00:00,0.02,bad\n")
    assert [r.vsr for r in S.read_station_pairs(spark, str(p)).collect()] == [1.5]


def test_products_fail_loudly(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("line_id"), F.lit(float("nan")).alias("v")).write.parquet(str(tmp_path / "pass"))
    got = S.read_products(spark, str(tmp_path), [1], {"pass": ["line_id", "v"]})["pass"]
    assert got.collect()[0].v is None and got.count() == 1
    with pytest.raises(ValueError, match="missing"):
        S.read_products(spark, str(tmp_path), None, {"pass": ["line_id", "w"]})


def test_append_missing_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 1, 3, 0.6)], "line_id string, ref_idx int, sec_idx int, v double")
    out = str(tmp_path / "pairs")
    append_missing(df.limit(1), out)
    append_missing(df, out)
    append_missing(df, out)
    assert S.read_pair_outputs(spark, out, ["a"]).count() == 2
    assert S.read_pair_outputs(spark, out, ["b"]).count() == 0


def test_station_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S4", 1.25, 0.04, 0.75, 30)], "site string, mm_per_m double, sigma double, r2 double, n int")
    out = str(tmp_path / "adm")
    S.write_station_table(df, out, ["a note"])
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[0] == "# a note" or "# a note" in lines
    back = S.read_stations(spark, out, ("site", "mm_per_m", "sigma", "r2", "n"), ("mm_per_m", "sigma", "r2", "n")).collect()
    assert len(back) == 1 and back[0].mm_per_m == 1.25


def test_rerun_diff(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x", 0), (2, None, "q", 0)], "k int, v double, s string, extra int")
    got = {r.field: r.n_diff for r in S.rerun_diff(a, b, ["k"], {"v": 1e-6}).collect()}
    assert got == {"v": 0, "s": 1, "(rows)": 1}
    assert {r.field: r.n_diff for r in S.rerun_diff(a, b.drop("s"), ["k"]).collect()}["(lost) s"] == 3


def test_stations_by_any_kind_of_path(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# x y site\n1.0 2.0 A\n")
    assert S.read_stations(spark, f"{tmp_path}/s.txt").count() == S.read_stations(spark, f"file:{tmp_path}/s.txt").count() == 1
    assert S.read_stations(spark, f"file:{tmp_path}/none.txt").count() == 0


def test_products_are_checked_by_type_with_all_deviations_named(spark, tmp_path):
    spark.createDataFrame([("a", "1", "s", True)], "line_id string, pass_idx string, day_seg string, enabled boolean").write.parquet(str(tmp_path / "pass"))
    spark.createDataFrame([("a", 1, 2, [1], [2.0])], "line_id string, pass_idx int, col int, re array<int>, im array<float>").write.parquet(str(tmp_path / "slc"))
    want = {k: S.PRODUCT_SCHEMA[k] for k in ("pass", "slc")}
    with pytest.raises(ValueError) as e:
        S.read_products(spark, str(tmp_path), None, want)
    assert str(e.value) == "pass.pass_idx: int wanted, string found; slc.re: array<double> wanted, array<int> found"
    ok = spark.createDataFrame([(7, 1, 2, [1.0, float("inf")], [2.0])], "line_id long, pass_idx smallint, col int, re array<double>, im array<float>")
    ok.write.parquet(str(tmp_path / "ok" / "slc"))
    got = S.read_products(spark, str(tmp_path / "ok"), None, {"slc": S.PRODUCT_SCHEMA["slc"]})["slc"].first()
    assert got.re == [1.0, None]


def test_verify_joins_only_the_ranges_that_differ(spark):
    a = spark.range(40_000).select((F.col("id") % 7).alias("line"), "id", (F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("w"), F.lit(None).cast("double").alias("none"))
    b = a.withColumn("v", F.when(F.col("id") == 777, 1.0).otherwise(F.col("v")))
    bad = S.differing_ranges(a, b, ["line", "id"], ["line"]).collect()
    assert len(bad) == 1 and bad[0].line == 0
    plain = lambda f: sorted((r.field, r.n_diff, r.max_abs) for r in f.collect())
    cases = [(b, None), (a, None), (b.where("id <> 5"), None), (a.unionByName(a.where("id = 3").withColumn("id", F.lit(10**6))), None), (b.withColumn("v", F.col("v") + 1e-9), {"v": 1e-6}),
             (a.withColumn("line", F.col("line") + 1), None), (b.drop("w"), None), (b.withColumn("more", F.lit(1)), None), (a.where("1 = 0"), None)]
    for other, tol in cases:
        key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
        assert sorted(plain(S.verify_rerun(a, other, ["line", "id"], ["line"], tol)), key=key) == sorted(plain(S.rerun_diff(a, other, ["line", "id"], tol)), key=key)
