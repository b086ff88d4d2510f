"""The query plan: one aggregate at most, AND-ed filters, equi-join edges, one sort key."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

INTENTS = ("lookup", "distinct", "ranking", "filter", "comparison", "existence", "count", "row_count", "column_count", "column_names", "aggregation", "derived_aggregation", "percentage", "unsupported")
AGGREGATIONS = ("count", "sum", "average", "min", "max", "median")
COMPARISONS = ("equals", "not_equals", "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal")
OPERATORS = (*COMPARISONS, "contains", "starts_with", "ends_with", "in", "not_in", "between", "year", "is_null", "is_not_null")
GRANULARITIES = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Ref:
    """A column of a named table."""

    table: str
    column: str

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass(frozen=True)
class Join:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    join_type: str = "inner"


@dataclass(frozen=True)
class Plan:
    intent: str
    table: str | None = None
    target_columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    having_filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregation: str | None = None
    inner_aggregation: str | None = None
    sort_column: str | None = None
    sort_direction: str | None = None
    limit: int | None = None
    include_ties: bool = False
    distinct: bool = False
    require_all_filter_values: bool = False
    input_result_reference: str | None = None
    explanation: str = ""
    confidence: float = 1.0
    joins: tuple[Join, ...] = ()
    group_by_granularity: str | None = None

    def with_(self, **changes: Any) -> Plan:
        return replace(self, **changes)

    def tables(self) -> list[str]:
        """Tables that the joins name, in order."""
        return list(dict.fromkeys(t for j in self.joins for t in (j.left_table, j.right_table)))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)

    @classmethod
    def from_json(cls, text: str | dict) -> Plan:
        raw = json.loads(text) if isinstance(text, str) else dict(text)
        known = {f.name for f in fields(cls)}
        if unknown := set(raw) - known:
            raise ValueError(f"unknown plan fields: {sorted(unknown)}")
        kinds = {"filters": Filter, "having_filters": Filter, "joins": Join}
        out = {}
        for k, v in raw.items():
            if k in kinds:
                v = tuple(x if isinstance(x, kinds[k]) else kinds[k](**x) for x in v or ())
            elif k in ("target_columns", "group_by"):
                v = tuple(v or ())
            out[k] = v
        return cls(**out)
