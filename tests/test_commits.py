"""Commits of pair outputs: killed writers, repeated runs, two writers at once, provenance."""

import os

import pytest
from pyspark.sql import functions as F

from echofold.streaming import commits as C


def frame(spark, keys, v):
    return spark.createDataFrame([(k, 1, s, v) for k in keys for s in (2, 3)], "line_id string, ref_idx int, sec_idx int, v double")


def rows(spark, path):
    return sorted((r.line_id, r.sec_idx, r.v, r.version) for r in C.read_commits(spark, path).collect())


def test_a_write_that_is_killed_leaves_nothing_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    assert C.write_pairs(frame(spark, "ab", 1.0), path, "b1") == 0
    dies = frame(spark, "abcdef", 2.0).repartition(4).withColumn("v", F.when(F.col("line_id") == "f", F.raise_error("executor lost").cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="executor lost"):
        C.write_pairs(dies, path, "b2")
    assert rows(spark, path) == [("a", 2, 1.0, 0), ("a", 3, 1.0, 0), ("b", 2, 1.0, 0), ("b", 3, 1.0, 0)]
    # Killed between the data and the log: staged in full, never published.
    publish = C._Log.publish
    C._Log.publish = lambda self, entry: (_ for _ in ()).throw(KeyboardInterrupt())
    try:
        with pytest.raises(KeyboardInterrupt):
            C.write_pairs(frame(spark, "abc", 3.0), path, "b3")
    finally:
        C._Log.publish = publish
    assert len(rows(spark, path)) == 4 and len(os.listdir(f"{path}/data")) >= 2
    assert C.write_pairs(frame(spark, "abc", 3.0), path, "b3") == 1 and C.write_pairs(frame(spark, "abc", 4.0), path, "b4") is None
    assert [r[2] for r in rows(spark, path)] == [1.0] * 4 + [3.0] * 2


def test_two_writers_keep_each_key_once(spark, tmp_path):
    """The second writer publishes while the first has staged; the first drops what is there by then."""
    path, publish, met = str(tmp_path / "t"), C._Log.publish, []

    def late(self, entry):
        if not met:
            met.append(1)
            C.write_pairs(frame(spark, "bc", 2.0), path, "other")
        return publish(self, entry)

    C._Log.publish = late
    try:
        assert C.write_pairs(frame(spark, "ab", 1.0), path, "mine") == 1
    finally:
        C._Log.publish = publish
    assert rows(spark, path) == [("a", 2, 1.0, 1), ("a", 3, 1.0, 1), ("b", 2, 2.0, 0), ("b", 3, 2.0, 0), ("c", 2, 2.0, 0), ("c", 3, 2.0, 0)]
    assert not C._Log(spark, path).publish({"version": 1})
    assert not [f for f in os.listdir(f"{path}/log") if f.startswith("_")]


def test_provenance_partitions_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    assert C.read_commits(spark, path) is None
    C.write_pairs(frame(spark, "a", 1.0), path, "b1", {"window": [5, 15]}, partition_by=["line_id"], code_version="7")
    C.write_pairs(frame(spark, ["a", None], 2.0).withColumn("extra", F.lit(3)), path, "b2")
    C.write_pairs(frame(spark, [None], 5.0), path, "b3")
    got = {(r.line_id, r.sec_idx): r for r in C.read_commits(spark, path).collect()}
    assert len(got) == 4 and got["a", 2].input_build == "b1" and got["a", 2].options == '{"window": [5, 15]}' and got["a", 2].code_version == "7" and got["a", 2].extra is None
    assert got[None, 3].extra == 3 and C.read_commits(spark, path, 0).count() == 2
    assert [(r.version, r["rows"], r.input_build) for r in C.commits(spark, path).orderBy("version").collect()] == [(0, 2, "b1"), (1, 2, "b2")]
