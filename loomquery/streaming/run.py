"""Grouped plans over a streaming table. Batch queries come first; this is the same plan on a stream, nothing more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomquery.errors import PlanError
from loomquery.operators.compile import VALUE, _filters, aggregate, col, scope
from loomquery.plans.ir import Plan
from loomquery.sources.catalog import Catalog

WIDTH = {"day": "1 day", "week": "7 days"}


def windowed(catalog: Catalog, plan: Plan, time_column: str, late: str = "1 hour") -> DataFrame:
    """The plan's aggregate by key and by windows of its granularity (day or week), with a watermark: windows close so long after the latest time seen, and rows that come later are left out."""
    if plan.joins or not plan.aggregation or plan.aggregation == "median" or plan.group_by_granularity not in WIDTH:
        raise PlanError("a stream takes a count, sum, average, min or max over one table, by day or week")
    s = scope(catalog, plan, plan.table)
    ref = s.ref(time_column)
    measure = s.measure(plan.aggregation)
    frame = s.where(s.frame, _filters(s))
    frame = frame.select(col(ref).cast("timestamp").alias("at"), *[col(s.ref(g)).alias(g) for g in plan.group_by if s.ref(g) != ref], *([col(measure).alias("measure")] if measure else []))
    value = aggregate(plan.aggregation, F.col("measure") if measure and plan.aggregation != "count" else None)
    start = {"startTime": "4 days"} if plan.group_by_granularity == "week" else {}  # weeks begin on Monday, the epoch on a Thursday
    windows = F.window("at", WIDTH[plan.group_by_granularity], **start)
    keys = [g for g in plan.group_by if s.ref(g) != ref]
    return frame.withWatermark("at", late).groupBy(windows.alias("window"), *keys).agg(value.alias(VALUE)).select(F.to_date("window.start").alias(time_column), *keys, VALUE)


def to_parquet(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows under path; after a failure the query goes on from the checkpoint, which all executors must share."""
    return frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
