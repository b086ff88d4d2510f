"""Type families by Spark type, never by name, and the coercion of plan values to a column's type."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.errors import PlanError

TRUE, FALSE = {"1", "true", "t", "yes", "y"}, {"0", "false", "f", "no", "n"}


def family(kind: T.DataType) -> str:
    """numeric, temporal, boolean, string, binary, vector or other."""
    for name, kinds in (("numeric", T.NumericType), ("temporal", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("boolean", T.BooleanType), ("string", (T.StringType, T.CharType, T.VarcharType)), ("binary", T.BinaryType)):
        if isinstance(kind, kinds):
            return name
    return "vector" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType) else "other"


def literal(value: Any, kind: T.DataType) -> Column:
    """The value as the column's type where one is called for: dates and times from text, booleans from their usual spellings."""
    what = family(kind)
    if what == "boolean" and not isinstance(value, bool):
        text = str(value).strip().lower()
        if text not in TRUE | FALSE:
            raise PlanError(f"{value!r} is no boolean")
        return F.lit(text in TRUE)
    if what == "temporal":
        return F.lit(value).cast(kind)
    if what == "string" and not isinstance(value, str):
        return F.lit(str(value))
    return F.lit(value)
