"""Medians of groups of which some are large: these are not shuffled by group."""

from pyspark.sql import functions as F

from loomquery.operators import compile as compiled


def test_large_groups_meet_their_bracket_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(compiled, "HOT_ROWS", 50)
    rows = spark.range(900).select(F.when(F.col("id") % 9 > 3, "big").when(F.col("id") % 9 > 0, F.concat(F.lit("g"), (F.col("id") % 100).cast("string"))).alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37) % 501).alias("m"))
    rows = rows.union(spark.createDataFrame([("none", None)], "k string, m long"))
    made = compiled.median(rows, ["k"], "m", "v")
    want = rows.groupBy("k").agg(F.percentile("m", F.lit(0.5)).alias("v"))
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "rightHint=(strategy=broadcast)" in plan
