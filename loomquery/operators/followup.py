"""Follow-ups on an earlier result: filter, sort, project, limit, count, over the earlier DataFrame itself, so over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.errors import PlanError
from loomquery.functions.types import family
from loomquery.plans.ir import Filter, Plan

from .compile import COMPARE, VALUE


def _column(df: DataFrame, name: str) -> str:
    bare = name.split(".")[-1].lower()
    found = [c for c in df.columns if c.lower() == name.lower()] or [c for c in df.columns if c.split(".")[-1].lower() == bare]
    if len(found) != 1:
        raise PlanError(f"{name!r} is not one column of the earlier result {df.columns}")
    return found[0]


def predicate(df: DataFrame, f: Filter) -> Column:
    """Text is matched whatever its case and literally; order comparisons are numeric where both sides are numbers; not_equals keeps nulls."""
    name = _column(df, f.column)
    c, text = F.col(f"`{name}`"), F.lower(F.col(f"`{name}`").cast("string"))
    value = f.value
    if f.operator in ("is_null", "null") or f.operator == "equals" and value is None:
        return c.isNull()
    if f.operator in ("is_not_null", "not_null") or f.operator == "not_equals" and value is None:
        return c.isNotNull()
    if f.operator in ("contains", "starts_with", "ends_with"):
        word = F.lit(str(value).lower())
        return {"contains": text.contains(word), "starts_with": text.startswith(word), "ends_with": text.endswith(word)}[f.operator]
    if f.operator == "in":
        return c.cast("string").isin([str(v) for v in value])
    if f.operator in ("equals", "not_equals"):
        same = c.eqNullSafe(F.lit(value)) if family(df.schema[name].dataType) != "string" else c.eqNullSafe(F.lit(str(value)))
        return same if f.operator == "equals" else ~same
    if f.operator in COMPARE:
        if family(df.schema[name].dataType) == "temporal":
            return getattr(c, COMPARE[f.operator])(F.lit(value).cast(df.schema[name].dataType))
        return getattr(c.try_cast("double"), COMPARE[f.operator])(F.lit(float(value)))
    raise PlanError(f"unknown operator {f.operator!r}")


def eligible(plan: Plan, df: DataFrame) -> bool:
    """True if the earlier result alone can answer: no joins, no aggregate but a count, and only its columns."""
    names = [*plan.target_columns, *[f.column for f in plan.filters], *([plan.sort_column] if plan.sort_column else [])]
    try:
        [_column(df, n) for n in names if n != "*"]
    except PlanError:
        return False
    return not plan.joins and not plan.group_by and plan.aggregation in (None, "count")


def follow_up(df: DataFrame, plan: Plan) -> DataFrame:
    for f in plan.filters:
        df = df.where(predicate(df, f))
    if plan.sort_column:
        c = F.col(f"`{_column(df, plan.sort_column)}`")
        key = F.lower(c) if family(df.schema[_column(df, plan.sort_column)].dataType) == "string" else c
        df = df.orderBy(key.desc_nulls_first() if (plan.sort_direction or "asc").lower() == "desc" else key.asc_nulls_last())
    targets = [t for t in plan.target_columns if t != "*"]
    if targets and plan.intent != "count" and plan.aggregation != "count":
        df = df.select(*[F.col(f"`{_column(df, t)}`").alias(t) for t in targets])
    if plan.limit:
        df = df.limit(plan.limit)
    return df.agg(F.count(F.lit(1)).alias(VALUE)) if plan.intent == "count" or plan.aggregation == "count" else df


def details(earlier: Plan, asked: Plan) -> Plan:
    """The rows behind an earlier aggregate: its table, joins and filters stay, what was asked comes on top, and nothing is aggregated. Over joins rows are distinct, as one may be met several times."""
    targets = asked.target_columns or tuple(dict.fromkeys((*earlier.group_by, *[t for t in earlier.target_columns if t != "*"])))
    filters = (*earlier.filters, *[f for f in asked.filters if f not in earlier.filters])
    return Plan("lookup", table=earlier.table, target_columns=targets, filters=filters, joins=earlier.joins, distinct=bool(earlier.joins), sort_column=asked.sort_column, sort_direction=asked.sort_direction, limit=asked.limit)


def bounded(df: DataFrame) -> DataFrame:
    """What a conversation may keep: the first 100 rows, or the first 1000 distinct values of a single column, in the result's order."""
    if len(df.columns) > 1:
        return df.limit(100)
    name = df.columns[0]
    placed = df.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("v"), F.monotonically_increasing_id().alias("at"))
    return placed.groupBy("v").agg(F.min("at").alias("at")).orderBy("at").limit(1000).select(F.col("v").alias(name))


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 1000").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


_SQL = "(SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 1000)"
_CASES = {
    "q_followup_filter": (Plan("lookup", filters=(Filter("c_mktsegment", "contains", "build"),)), f"SELECT * FROM {_SQL} WHERE contains(lower(c_mktsegment), 'build')"),
    "q_followup_sort": (Plan("lookup", target_columns=("c_custkey", "c_acctbal"), sort_column="c_acctbal", sort_direction="desc", limit=8), f"SELECT c_custkey, c_acctbal FROM {_SQL} ORDER BY c_acctbal DESC LIMIT 8"),
    "q_followup_limit": (Plan("lookup", target_columns=("c_custkey",), filters=(Filter("c_acctbal", "less_than", "2000"),), sort_column="c_custkey", limit=20), f"SELECT c_custkey FROM {_SQL} WHERE c_acctbal < 2000 ORDER BY c_custkey LIMIT 20"),
    "q_followup_count": (Plan("count", filters=(Filter("c_mktsegment", "not_equals", "BUILDING"),)), f"SELECT count(*) AS {VALUE} FROM {_SQL} WHERE c_mktsegment <> 'BUILDING'"),
}
QUERIES = {n: (lambda spark, sf_dir, p=p: follow_up(_earlier(spark, sf_dir), p)) for n, (p, _) in _CASES.items()}
ORACLE = {n: sql for n, (_, sql) in _CASES.items()}
