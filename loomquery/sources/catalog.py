"""The catalog: tables, declared keys, name resolution and fingerprint. Parquet declares no keys, so they come from a sidecar."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.errors import AmbiguousColumn, PlanError, masked
from loomquery.plans.ir import Ref


@dataclass(frozen=True)
class ForeignKey:
    """Ordered column pairs, so that a composite key stays one."""

    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass
class Table:
    name: str
    df: DataFrame
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()

    def column(self, name: str) -> str | None:
        """The column's own spelling, whatever the case of name."""
        return next((c for c in self.df.columns if c.lower() == name.lower()), None)


@dataclass
class Catalog:
    items: dict[str, Table]
    foreign_keys: tuple[ForeignKey, ...] = ()
    validated: dict[tuple[str, str, str, str], float] = field(default_factory=dict)  # edges that data has confirmed, and how surely

    @classmethod
    def of(cls, frames: dict[str, DataFrame], primary_keys: dict[str, tuple[str, ...]] | None = None, foreign_keys: tuple[ForeignKey, ...] = (), unique: dict[str, tuple[tuple[str, ...], ...]] | None = None) -> Catalog:
        pk, uq = primary_keys or {}, unique or {}
        return cls({n.lower(): Table(n, df, tuple(pk.get(n, ())), tuple(uq.get(n, ()))) for n, df in frames.items()}, tuple(foreign_keys))

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, tables: list[str], **keys) -> Catalog:
        return cls.of({t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}, **keys)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, tables: list[str], options: dict[str, str] | None = None, split: dict[str, tuple[str, int, int, int]] | None = None, **keys) -> Catalog:
        """Tables of a relational database through Spark's connector, which pushes filters and columns down.

        split: for large tables, the column, its least and greatest value and the number of ranges that tasks read side by side.
        """
        ranges = {t: dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, s))) for t, s in (split or {}).items()}
        return cls.of({t: spark.read.format("jdbc").options(url=url, dbtable=t, **ranges.get(t, {}), **(options or {})).load() for t in tables}, **keys)

    def probe(self, spark: SparkSession, database: str | None = None) -> dict[str, str | int]:
        """The session's catalog and database and the number of tables whose first row can be read. PlanError if the database is another than the one expected, or a table cannot be read."""
        now = spark.catalog.currentDatabase()
        if database is not None and now.lower() != database.lower():
            raise PlanError(f"the session is connected to {now!r}, not to {database!r}")
        for t in self.items.values():
            try:
                t.df.limit(1).count()
            except PySparkException as e:
                raise PlanError(f"table {t.name} cannot be read: {masked(str(e).splitlines()[0])}") from e
        return {"catalog": spark.catalog.currentCatalog(), "database": now, "tables": len(self.items)}

    def table(self, name: str) -> Table:
        bare = strip(name).split(".")[-1].lower()
        if bare not in self.items:
            raise PlanError(f"no table {name!r}; there are {sorted(self.items)}")
        return self.items[bare]

    def resolve(self, text: str | Ref, among: list[str], prefer: str | None = None) -> Ref:
        """A reference in col, table.col or schema.table.col form, quoted or not, to the one column it fits among these tables."""
        if isinstance(text, Ref):
            text = str(text)
        parts = split_reference(text)
        scope = [self.table(t) for t in among]
        if len(parts) > 1:
            scope = [t for t in scope if t.name.lower() == parts[-2].lower()]
            if not scope:
                raise PlanError(f"{text!r} names a table that the plan does not read")
        found = [Ref(t.name, c) for t in scope if (c := t.column(parts[-1]))]
        if not found:
            raise PlanError(f"no column {text!r} in {[t.name for t in scope]}")
        if len(found) > 1:
            found = [r for r in found if prefer and r.table.lower() == prefer.lower()] or found
        if len(found) > 1:
            raise AmbiguousColumn(f"{text!r} fits {[str(r) for r in found]}")
        return found[0]

    def grain(self, name: str, suffixes: tuple[str, ...] = ("_id", "_sitecore_id", "id")) -> tuple[str, ...]:
        """The columns that tell rows of a table apart: its key, else what its names suggest (with such suffixes), else all of them."""
        t = self.table(name)
        if t.primary_key:
            return t.primary_key
        low = {c.lower(): c for c in t.df.columns}
        base, single = t.name.lower(), t.name.lower().removesuffix("s")
        for guess in ("id", *(f"{b}{s}" for s in suffixes for b in (base, single))):
            if guess in low:
                return (low[guess],)
        ids = tuple(c for k, c in low.items() if k.endswith((*[s for s in suffixes if s.startswith("_")], "_key")))
        return ids or tuple(t.df.columns)

    def is_unique(self, name: str, columns: tuple[str, ...]) -> bool:
        t = self.table(name)
        want = {c.lower() for c in columns}
        return any(k and {c.lower() for c in k} <= want for k in (t.primary_key, *t.unique))

    def verify_keys(self) -> list[str]:
        """Drops declared keys that the data contradict and returns their tables. One distributed count a key."""
        bad = []
        for t in self.items.values():
            if t.primary_key and t.df.groupBy(*t.primary_key).count().where("count > 1").limit(1).count():
                t.primary_key = ()
                bad.append(t.name)
        return bad

    def row_counts(self) -> DataFrame:
        """(table_name, row_count) of all tables, in one job; Parquet answers from its footers."""
        each = [t.df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t.name).alias("table_name"), "row_count") for t in self.items.values()]
        return reduce(DataFrame.unionByName, each)

    def fingerprint(self) -> str:
        """SHA-256 over names, types and keys; rows do not enter."""
        shape = {
            "tables": {k: [[f.name, f.dataType.simpleString(), f.nullable] for f in t.df.schema] for k, t in sorted(self.items.items())},
            "primary": {k: list(t.primary_key) for k, t in sorted(self.items.items())},
            "unique": {k: sorted(map(list, t.unique)) for k, t in sorted(self.items.items())},
            "foreign": sorted([f.table, list(f.columns), f.parent, list(f.parent_columns)] for f in self.foreign_keys),
        }
        return hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()

    def authorised(self, left: Ref, right: Ref) -> bool:
        """True for a declared foreign key of one column or a confirmed edge, either way round."""
        pair = {(left.table.lower(), left.column.lower()), (right.table.lower(), right.column.lower())}
        declared = any(len(f.columns) == 1 and pair == {(f.table.lower(), f.columns[0].lower()), (f.parent.lower(), f.parent_columns[0].lower())} for f in self.foreign_keys)
        return declared or any({(a.lower(), b.lower()), (c.lower(), d.lower())} == pair for a, b, c, d in self.validated)


def strip(name: str) -> str:
    return re.sub(r'[\[\]"`]', "", name).strip()


def split_reference(text: str) -> list[str]:
    parts = [p.strip() for p in strip(text).split(".")]
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise PlanError(f"{text!r} is no column reference")
    return parts
