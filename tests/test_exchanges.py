"""Rows that belong to a line or a profile are exchanged by it once, before they are aggregated."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from echofold.operators import matching, regress
from echofold.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.mark.parametrize("name", ["repeat_interval", "depth_matched_strain", "rate_regression_by_depth", "block_size_sweep"])
def test_raw_rows_travel_before_they_are_grouped(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert text.count("REPARTITION_BY_COL") == text.count("FileScan parquet")


@pytest.mark.parametrize("rows", [500_000, 20])
def test_layer_medians_of_bounded_and_long_lines_agree(spark, rows):
    blocks = spark.range(6).select((F.col("id") % 2).alias("line_id"), F.floor(F.col("id") / 2).alias("block"),
                                   (F.floor(F.col("id") / 2) * 200.0).alias("x"), F.lit(0.0).alias("y"))
    picks = spark.range(400).select((F.col("id") % 2).alias("line_id"), (F.col("id") * 1.5).alias("px"), (F.col("id") % 7 * 3.0).alias("py"),
                                    (F.col("id") % 13 + F.when(F.col("id") % 50 == 0, 900).otherwise(100)).cast("double").alias("h"))
    got = {tuple(r) for r in matching.layer_to_blocks(blocks, picks, 100.0, 15.0, 10.0, 0.5, rows=rows).collect()}
    want = set()
    p = picks.toPandas()
    for line in (0, 1):
        q = p[p.line_id == line]
        med = q.h.median()
        ok = (q.h - med).abs() <= 5 * 1.4826 * (q.h - med).abs().median()
        for b in range(3):
            inn = ((q.px - 200.0 * b).abs() <= 100) & (q.py <= 15)
            d = ((q.px - 200.0 * b) ** 2 + q.py ** 2) ** 0.5
            want.add((line, b, q.h[inn & ok].median(), int((inn & ok).sum()), int(inn.sum()), d.min()))
    assert got == want


def test_times_that_come_again_are_looked_up_once(spark):
    tide = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0)], "site string, ts_s double, tide_m double")
    pairs = spark.createDataFrame([("a", 2.5)] * 5 + [("a", 7.5)], "site string, ts_s double")
    f = regress.tide_fraction(pairs, tide)
    assert f.collect()[0].tide_fraction == 0.5
    assert "keys=[site" in plan(f)
