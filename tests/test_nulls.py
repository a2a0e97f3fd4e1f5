"""Rows with a null key, bucket or class stay."""

from pyspark.sql import functions as F

from kerbline.operators import components as C
from kerbline.operators import events as E
from kerbline.operators import ordered as O
from kerbline.operators import splits as S
from kerbline.operators import tracks as T
from kerbline.operators.build import box_numbers


def test_box_numbers_keep_rows_without_frame_or_corner(spark):
    rows = [(1, 1.0, 2.0), (1, None, 2.0), (None, 3.0, 4.0), (2, 5.0, 6.0)]
    got = box_numbers(spark.createDataFrame(rows, "frame int, x1 double, x2 double"), "frame", ["x1", "x2"])
    assert sorted((r.frame is None, r.frame or 0, r.box_no) for r in got.collect()) == [(False, 1, 0), (False, 1, 1), (False, 2, 0), (True, 0, 0)]


def test_stratified_split_keeps_rows_without_class(spark):
    rows = [(1, "a"), (2, None), (3, None), (4, "b")]
    got = S.stratified_split(spark.createDataFrame(rows, "k int, c string"), "k", "c", 0.5, 1).collect()
    assert len(got) == 4 and sum(r.split == "val" for r in got if r.c is None) == 1


def test_states_samples_and_smoothing_keep_a_null_stream(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 9.0), ("s", 0, 2.0)], "s string, t int, v double")
    step = lambda state, row: F.when(row["v"] > 5, F.lit("high")).otherwise(state)
    states = O.fold_states(df, ["s"], ["t"], O.tick_bucket("t"), ["", "high"], step, ["v"]).collect()
    assert sorted((r.s or "", r.t, r.state) for r in states) == [("", 0, ""), ("", 1, "high"), ("s", 0, "")]
    assert T.change_sample(df, ["s"], "t", "v", 0.2).count() == 3
    assert E.smoothed(df, "s", "t", "v").count() == 3


def test_components_of_a_node_with_very_many_edges(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_EDGES", 1_000)
    star = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    chain = spark.range(30_000, 30_040).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = C.components(star.unionByName(chain)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, 20_001), (30_000, 41)}
