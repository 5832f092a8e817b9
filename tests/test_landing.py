"""The landing zone holds many fetches per file; steps whose memory is a multiple of their input are dealt by its size."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from gossamer.operators import corroborate as C
from gossamer.operators import places as P
from gossamer.sources import adapter as A
from gossamer.sources import feeds as S
from gossamer.sources import landing as L
from gossamer.sources import messages as MS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fetches_share_files(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 3000).alias("batch"))
    record = F.when(F.col("id") == 7, F.lit("{cut off")).otherwise(F.to_json(F.struct(F.col("id").alias("n"))))
    folder = L.write_documents(rows, record, F.col("batch"), '{"features": [', "]}")
    assert len(list(Path(folder).rglob("part-*"))) <= 64
    read = S.read_features(spark, folder, "struct<n: bigint>").select("batch_id", "f.n").collect()
    assert sorted((r["batch_id"], r["n"]) for r in read if r["n"] is not None) == sorted((i % 3000, i) for i in range(6000) if i % 3000 != 7)
    assert [(r["batch_id"], r["lost"]) for r in L.unreadable(spark, folder, "features array<struct<n: bigint>>").collect()] == [(7, True)]


def test_delimited_lines_keep_heads_blanks_and_order(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, " b ", "x"), (2, "c", "y")], "batch long, p string, q string")
    piped = L.write_lines(rows, ["p", "q"], F.col("batch"), "|")
    got = S.read_pipe(spark, piped, ["p", "q", "r"]).select("p", "q", "r", F.col("line.batch_id").alias("b"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", None, None, 1), (" b ", "x", None, 1), ("c", "y", None, 2)], key=str)
    spaced = L.write_lines(rows, ["p", "q"], F.col("batch"), ",", header=True)
    assert sorted(r["p"] for r in S.read_csv_spaced(spark, spaced, ["p", "q"]).collect()) == ["a", "b", "c"]


def test_configuration_is_broadcast(spark):
    bids = spark.createDataFrame([("Corn", "D", "p", None, "5", None, None, None, None, "Yes", "01/02/2024", "01/02/2024", None, None)], S.GRAIN_ROW)
    com = spark.createDataFrame([("Corn", "corn_basis", 0.01)], "commodity string, metric string, a double")
    reg = spark.createDataFrame([("D", "17001", 40.0, -89.0)], "trade_loc string, county_id string, lat double, lon double")
    assert "SortMergeJoin" not in plan(S.normalize_grain_bids(bids, com, reg, "America/Chicago"))
    rows = spark.createDataFrame([("x", 1.0)], "code string, raw_value double")
    mapping = spark.createDataFrame([("x", "m", 1.0, 0.0, None, None, None, False)], "code string, metric string, a double, b double, period string, lo double, hi double, is_flag boolean")
    assert "SortMergeJoin" not in plan(S.mapped(rows, mapping))


def test_nearest_zip_groups_no_pairs(spark):
    zips = spark.createDataFrame([("60002", 2, 40.0, -89.0), ("60001", 1, 40.0, -89.0), ("60003", 3, 40.05, -89.0), ("60004", 4, None, None)], "zip5 string, ord long, lat double, lon double")
    points = spark.createDataFrame([(1, 40.0, -89.0), (2, 40.04, -89.0), (3, 45.0, -89.0), (4, None, None), (5, 40.0, -89.17)], "id long, lat double, lon double")
    near = P.nearest_zip(points, "id", zips, 15.0)
    assert {r["id"]: r["zip5"] for r in near.collect()} == {1: "60001", 2: "60003", 5: "60001"}
    assert "km" not in "".join(line for line in plan(near).splitlines() if "Aggregate" in line)


def test_memory_bound_steps_are_dealt_by_size(spark, sf):
    fr = (A.dim_metric(spark), spark.createDataFrame([], "metric string, unit string, a double, b double, expr string, is_default boolean"), spark.createDataFrame([], "metric string, word string, value double"))
    said = MS.extract_readings(A.signals(spark, sf).select("seq", "props").withColumnRenamed("props", "text"), "seq", {"aliases": [("click", "click", False)], "units": [], "words": []}, *fr)
    totals = C.settle_by_daily_total(A.signals(spark, sf), A.dim_metric(spark), (F.col("kind") == "station") & (F.col("period") == "24h"))
    assert "REPARTITION_BY_NUM" in plan(said)
    assert plan(totals).count("REPARTITION_BY_NUM") >= 3
