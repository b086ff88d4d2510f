import datetime as dt

from loomquery.operators.compile import compile_plan
from loomquery.plans.ir import Filter, Plan
from loomquery.sources.catalog import Catalog
from loomquery.streaming.run import to_parquet, windowed


def test_a_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), "ab"[i % 2], float(i)) for i in range(60)]
    batch = spark.createDataFrame(rows, "id int, ts timestamp_ntz, kind string, value double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    plan = Plan("aggregation", table="events", aggregation="sum", target_columns=("value",), group_by=("ts", "kind"), group_by_granularity="week", filters=(Filter("value", "greater_than", 3),))
    query = to_parquet(windowed(Catalog.of({"events": stream}), plan, "ts"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    got = {(r["ts"], r["kind"]): r["aggregation_value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["ts"], r["kind"]): r["aggregation_value"] for r in compile_plan(Catalog.of({"events": batch}), plan).collect()}
    last = max(k[0] for k in want)  # its window is still open
    assert got == {k: v for k, v in want.items() if k[0] != last} and got
