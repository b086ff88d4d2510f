"""Checks of a plan against the catalog, before any Spark action, and of a result against its intent."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from loomquery.errors import ContractError, PlanError
from loomquery.functions.types import family
from loomquery.operators.relations import Graph
from loomquery.sources.catalog import Catalog

from .ir import AGGREGATIONS, COMPARISONS, GRANULARITIES, INTENTS, OPERATORS, Plan, Ref

VIRTUAL = {"count", "sum", "average", "avg", "min", "max", "median", "aggregation_value"}
LOW, MODERATE = 0.50, 0.75


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def validate(plan: Plan, catalog: Catalog, table: str | None = None, strict: bool = False) -> Report:
    """strict: min, max and median need numbers too; otherwise any type that sorts will do for min and max."""
    r = Report()
    if plan.intent not in INTENTS:
        r.errors.append(f"unknown intent {plan.intent!r}")
    if plan.intent == "unsupported":
        r.errors.append(plan.explanation or "the question is not supported")
    names = plan.tables() or [t for t in (table or plan.table,) if t]
    try:
        scope = [catalog.table(n).name for n in names]
    except PlanError as e:
        r.errors.append(str(e))
        return r
    if not scope:
        r.errors.append("the plan names no table")
        return r

    def ref(text: str) -> Ref | None:
        try:
            return catalog.resolve(text, scope, prefer=scope[0])
        except PlanError as e:
            r.errors.append(str(e))
            return None

    kind = lambda x: family(catalog.table(x.table).df.schema[x.column].dataType)
    targets = [ref(t) for t in plan.target_columns if t != "*"]
    keys = [ref(g) for g in plan.group_by]
    for f in plan.filters:
        ref(f.column)
        if f.operator not in OPERATORS:
            r.errors.append(f"unknown operator {f.operator!r} on {f.column}")
        elif f.operator in ("in", "not_in") and not (isinstance(f.value, (list, tuple)) and f.value):
            r.errors.append(f"{f.operator} on {f.column} needs a list of values")
    for f in plan.having_filters:
        if not plan.aggregation:
            r.errors.append("HAVING needs an aggregation")
        if plan.aggregation == "median":
            r.errors.append("HAVING on a median is not supported")
        if not plan.group_by and not plan.joins:
            r.errors.append("HAVING needs groups")
        if f.operator not in COMPARISONS or f.value in (None, "") or isinstance(f.value, (list, tuple, dict)):
            r.errors.append(f"HAVING takes a comparison with one value, not {f.operator} {f.value!r}")
    if plan.aggregation and plan.aggregation not in AGGREGATIONS and plan.intent != "percentage":
        r.errors.append(f"unknown aggregation {plan.aggregation!r}")
    if plan.intent == "aggregation" and not plan.aggregation:
        r.errors.append("an aggregation needs a function")
    measured = plan.inner_aggregation if plan.intent == "derived_aggregation" else plan.aggregation
    if measured and measured != "count" and plan.intent != "percentage":
        if not targets:
            r.errors.append(f"{measured} needs a target column")
        elif targets[0] is not None:
            needs = strict or measured not in ("min", "max")
            if needs and kind(targets[0]) != "numeric" or kind(targets[0]) in ("vector", "other"):
                r.errors.append(f"{measured} needs a number; {targets[0]} is {kind(targets[0])}")
    if plan.intent == "derived_aggregation":
        if plan.aggregation not in AGGREGATIONS or plan.aggregation == "count":
            r.errors.append(f"{plan.aggregation!r} over groups is not provided")
        if (plan.inner_aggregation or "count") not in AGGREGATIONS:
            r.errors.append(f"unknown inner aggregation {plan.inner_aggregation!r}")
        if not plan.group_by:
            r.errors.append("an aggregate over groups needs its groups")
    if plan.intent == "ranking" and not plan.sort_column:
        r.errors.append("a ranking needs a sort column")
    if plan.sort_column and plan.sort_column.lower() not in VIRTUAL:
        ref(plan.sort_column)
    if plan.sort_direction and plan.sort_direction.lower() not in ("asc", "desc"):
        r.errors.append(f"unknown direction {plan.sort_direction!r}")
    if plan.limit is not None and plan.limit <= 0:
        r.errors.append("the limit must be over 0")
    if plan.group_by_granularity and plan.group_by_granularity not in GRANULARITIES:
        r.errors.append(f"unknown granularity {plan.group_by_granularity!r}")
    elif plan.group_by_granularity and keys and not any(k is not None and kind(k) == "temporal" for k in keys):
        r.errors.append(f"no group of the plan has a {plan.group_by_granularity}")
    if plan.confidence < LOW:
        r.warnings.append("low confidence")
    elif plan.confidence < MODERATE:
        r.warnings.append("moderate confidence")
    _joins(plan, catalog, r)
    return r


def _joins(plan: Plan, catalog: Catalog, r: Report) -> None:
    done: set[str] = set()
    seen = set()
    for j in plan.joins:
        try:
            a, b = (catalog.resolve(f"{t}.{c}", [t]) for t, c in ((j.left_table, j.left_column), (j.right_table, j.right_column)))
        except PlanError as e:
            r.errors.append(str(e))
            continue
        if j.join_type.lower() not in ("inner", "left", "right"):
            r.errors.append(f"unknown join type {j.join_type!r}")
        if not catalog.authorised(a, b):
            r.errors.append(f"{a} = {b} is no known relationship")
        if frozenset((a, b)) in seen:
            r.errors.append(f"{a} = {b} is joined twice")
        elif done and a.table in done and b.table in done:
            r.errors.append(f"{a} = {b} joins tables that are already joined")
        elif done and a.table not in done and b.table not in done:
            r.errors.append(f"{a} = {b} is not connected to the tables before it")
        seen.add(frozenset((a, b)))
        done |= {a.table, b.table}
    graph = Graph.known(catalog)
    for a, b in sorted({tuple(sorted((j.left_table, j.right_table))) for j in plan.joins}):
        if graph.ambiguous(a, b):
            r.warnings.append(f"{a} and {b} are connected in several ways")
    if len(plan.joins) > 1 and plan.aggregation:
        r.warnings.append("an aggregate over several joins: rows are told apart by the measure's table")


#: Rows that a result may bring to the driver; larger ones stay a DataFrame.
RESULT_ROWS = 100_000


def to_contract(plan: Plan, df: DataFrame, most: int = RESULT_ROWS) -> Any:
    """The result in Python: a scalar, a list of names, or a list of rows as dicts. Any result over joins is rows. ContractError if the shape is wrong or there are more rows than most."""
    if len(set(df.columns)) != len(df.columns):
        raise ContractError(f"columns repeat: {df.columns}")
    scalar = not plan.joins and not plan.group_by and plan.intent in ("row_count", "column_count", "count", "percentage", "aggregation", "existence") or plan.intent == "derived_aggregation"
    if not scalar:
        rows = [r.asDict() for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ContractError(f"the result has more than {most} rows: take its frame instead")
        return [r["column_name"] for r in rows] if plan.intent == "column_names" and not plan.joins else rows
    rows = df.take(2)
    if len(rows) != 1 or len(df.columns) != 1:
        raise ContractError(f"{plan.intent} should be one value, not {len(rows)} rows of {len(df.columns)}")
    value = rows[0][0]
    if plan.intent in ("row_count", "column_count", "count") and (isinstance(value, bool) or not isinstance(value, int)):
        raise ContractError(f"{plan.intent} should be a whole number, not {value!r}")
    if plan.intent == "percentage" and value is None:
        raise ContractError("a percentage cannot be null")
    return value
