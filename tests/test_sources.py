"""Batches that fail and are resumed, named sheets, and result tables."""

import os

import pytest
from pyspark.sql import functions as F

from rankloom.operators import reshape as S
from rankloom.sources.readers import BatchStore, SheetStore


def test_a_batch_fails_twice_and_is_resumed(spark, tmp_path):
    calls = []

    def read(name, fails):
        calls.append(name)
        if calls.count(name) <= fails.get(name, 0):
            return spark.range(10).select(F.col("id").alias("k"), F.raise_error(F.lit("connection lost")).alias("v"))
        return spark.range(int(name) * 10, int(name) * 10 + 12).select(F.col("id").alias("k"), F.lit(name).alias("v"))

    store = BatchStore(spark, f"{tmp_path}/pull", ["k"])
    wanted = spark.range(40).select(F.col("id").alias("k"))
    assert store.missing(wanted).count() == 40 and store.manifest().count() == 0  # nothing is there yet
    with pytest.raises(FileNotFoundError):
        store.latest("v")
    with pytest.raises(RuntimeError, match="'1'"):
        store.pull(["0", "1", "2"], lambda n: read(n, {"1": 2}), attempts=2)
    assert store.finished() == {"0", "2"} and sorted(r.k for r in store.missing(wanted).collect()) == [*range(12, 20), *range(32, 40)]
    # The attempt that died has left files of its own; they do not count and are replaced.
    spark.range(3).select(F.col("id").alias("k"), F.lit("lost").alias("v")).write.mode("overwrite").parquet(f"{tmp_path}/pull/data/batch=1")
    assert store.rows().where("v = 'lost'").isEmpty()
    again = BatchStore(spark, f"{tmp_path}/pull", ["k"])
    assert again.pull(["0", "1", "2", "3"], lambda n: read(n, {})) == ["1", "3"]
    assert calls == ["0", "1", "1", "2", "1", "3"]
    notes = [(r.batch, r.attempt, r.finished, r.rows) for r in again.manifest().orderBy("batch", "attempt").collect()]
    assert notes == [("0", 1, True, 12), ("1", 1, False, None), ("1", 2, False, None), ("1", 3, True, 12), ("2", 1, True, 12), ("3", 1, True, 12)]
    assert "connection lost" in again.manifest().where("not finished").first().error
    assert again.pull(["0", "1"], lambda n: read(n, {})) == []
    latest = {r.k: r.v for r in again.latest("v").collect()}
    assert len(latest) == 42 and latest[10] == "1" and latest[5] == "0"
    assert again.missing(wanted).isEmpty()


def test_sheets_are_listed(spark, tmp_path):
    store = SheetStore(spark, f"{tmp_path}/sheets")
    assert store.sheets() == []
    for name in ("Main Table (a)", "rcov"):
        for run in ("all", "half"):
            store.write(name, run, spark.range(3))
    assert store.sheets() == ["main_table_a", "rcov"] and store.read("rcov").count() == 6
    os.makedirs(f"{tmp_path}/sheets/_temporary")
    assert store.sheets() == ["main_table_a", "rcov"]


def test_a_place_has_one_result(spark):
    spec = spark.createDataFrame([("p", "r", "x", 1), ("p", "r", "y", 2), ("q", "r", "x", 9)], "panel string, row string, column string, key int")
    results = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.25, None)], "key int, estimate double, se double")
    got = {(r.panel, r.line): (r.x, r.y) for r in S.result_table(spec, results, ["key"], ["x", "y"], 2.0).collect()}
    assert got == {("p", "estimate"): (1.0, 0.5), ("p", "se"): (0.2, None), ("q", "estimate"): (None, None), ("q", "se"): (None, None)}
    with pytest.raises(Exception, match="several results"):
        S.result_table(spec.union(spec.limit(1)), results, ["key"], ["x"])
