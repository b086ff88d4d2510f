"""A plan to one lazy DataFrame. No SQL text is built: Catalyst sees filters, joins and aggregates as they are.

Inside, a column is named by table and column in one ("orders.o_orderkey"), so names never clash. Filters stand
before the joins' deduplication and so reach the scans; only the columns a plan needs are read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.errors import PlanError
from loomquery.functions.types import family, literal
from loomquery.plans.ir import Filter, Join, Plan, Ref
from loomquery.sources.catalog import Catalog

#: Rows of a lookup, or of any result over joins, where the plan sets no limit.
ROW_CAP = 5000
VALUE = "aggregation_value"
VIRTUAL = {"count", "sum", "average", "avg", "min", "max", "median", VALUE}
COMPARE = {"equals": "__eq__", "not_equals": "__ne__", "greater_than": "__gt__", "greater_than_or_equal": "__ge__", "less_than": "__lt__", "less_than_or_equal": "__le__"}


def col(ref: Ref) -> Column:
    return F.col(f"`{ref}`")


def predicate(c: Column, kind: T.DataType, op: str, value) -> Column:
    """One filter. A null value makes equals and not_equals tests for null. Wildcards in text patterns count as such."""
    if op in ("is_null", "null") or op == "equals" and value is None:
        return c.isNull()
    if op in ("is_not_null", "not_null") or op == "not_equals" and value is None:
        return c.isNotNull()
    if op in COMPARE:
        if op == "equals" and family(kind) == "temporal" and isinstance(value, int) and not isinstance(value, bool) and 1900 <= value <= 2100:
            return predicate(c, kind, "year", value)
        return getattr(c, COMPARE[op])(literal(value, kind))
    if op in ("contains", "starts_with", "ends_with"):
        return c.like({"contains": "%{}%", "starts_with": "{}%", "ends_with": "%{}"}[op].format(value))
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)) or not value:
            raise PlanError(f"{op} needs a list of values")
        found = c.isin([literal(v, kind) for v in value])
        return ~found if op == "not_in" else found
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise PlanError("between needs two values")
        return (c >= literal(value[0], kind)) & (c <= literal(value[1], kind))
    if op == "year":  # a range, so that the scan can use it
        return (c >= literal(f"{int(value)}-01-01", kind)) & (c < literal(f"{int(value) + 1}-01-01", kind))
    raise PlanError(f"unknown operator {op!r}")


def aggregate(name: str, c: Column | None) -> Column:
    if name == "count" or c is None:
        return F.count(F.lit(1) if c is None else c)
    known = {"sum": F.sum, "average": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "median": lambda x: F.percentile(x, F.lit(0.5))}
    if name not in known:
        raise PlanError(f"unknown aggregation {name!r}")
    return known[name](c)


#: percentile_approx places a rank within 1 / ACCURACY of the rows; the bracket round the median is five times as wide on either side.
ACCURACY = 100_000
#: Groups of more rows meet their bracket by broadcast (there is at most one such group in so many rows), so that no task sorts a whole one for the join.
HOT_ROWS = 1_000_000


def median(frame: DataFrame, keys: list[str], measure: str, name: str = VALUE) -> DataFrame:
    """The exact median of a column by groups (or of all rows), as percentile(0.5) has it.

    Approximate quantiles bracket the middle; the rows below are counted, and only values within the bracket, about one in
    10,000 of a group's rows, are sorted. So no task holds all values of a group. A group without values has a null.
    """
    m, share = F.col(f"`{measure}`").cast("double"), 5 / ACCURACY
    group = [F.col(f"`{k}`") for k in keys]
    rows = frame.select(*[c.alias(f"__k{i}") for i, c in enumerate(group)], m.alias("__m"))
    names = [f"__k{i}" for i in range(len(keys))]
    bounds = rows.groupBy(*names).agg(F.percentile_approx("__m", [0.5 - share, 0.5 + share], ACCURACY).alias("b"), F.count("__m").alias("n")).select(*[F.col(c).alias(f"_{c}") for c in names], F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"), "n")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]) if names else F.lit(True)
    held = rows.where("__m is not null")
    if names:
        hot = F.broadcast(bounds.where(F.col("n") > HOT_ROWS))
        held = held.join(hot, same).unionByName(held.join(hot, same, "left_anti").join(bounds.where(F.col("n") <= HOT_ROWS), same))
    else:
        held = held.join(F.broadcast(bounds), same)  # bounds is one row
    # Rows below the bracket count as one value.
    value = F.when(F.col("__m") >= F.col("lo"), F.col("__m"))
    counted = held.where(F.col("__m") <= F.col("hi")).groupBy(*names, value.alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    order = Window.partitionBy(*names).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("c").over(order))
    # The middle two ranks, from 1; of an odd number they are one.
    rank = lambda r: F.min(F.when(F.col("upto") >= r, F.col("v")))
    found = upto.groupBy(*names).agg((rank(F.floor((F.col("n") + 1) / 2)) * 0.5 + rank(F.floor(F.col("n") / 2) + 1) * 0.5).alias(name))
    if not names:
        return found
    found = found.select(*[F.col(c).alias(f"_{c}") for c in names], name)
    every = bounds.select(*[F.col(f"_{c}").alias(c) for c in names])
    return every.join(found, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]), "left").select(*[F.col(c).alias(k) for c, k in zip(names, keys)], name)


@dataclass
class Scope:
    """The tables of a plan, joined, and how its names resolve there."""

    catalog: Catalog
    plan: Plan
    tables: list[str]
    frame: DataFrame
    left_joined: list[str]
    capped: bool = True  # ROW_CAP holds where the plan sets no limit

    @property
    def joined(self) -> bool:
        return bool(self.plan.joins)

    def ref(self, text: str) -> Ref:
        return self.catalog.resolve(text, self.tables, prefer=self.tables[0])

    def kind(self, ref: Ref) -> T.DataType:
        return self.catalog.table(ref.table).df.schema[ref.column].dataType

    def key(self, text: str) -> Column:
        """A grouping key, cut to the plan's granularity where it is a date or time."""
        ref = self.ref(text)
        if not self.plan.group_by_granularity:
            return col(ref)
        if family(self.kind(ref)) != "temporal":
            if len(self.plan.group_by) == 1:
                raise PlanError(f"{ref} is no date or time: it has no {self.plan.group_by_granularity}")
            return col(ref)
        return F.to_date(F.date_trunc(self.plan.group_by_granularity, col(ref)))

    def where(self, frame: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
        for f in filters:
            ref = self.ref(f.column)
            frame = frame.where(predicate(col(ref), self.kind(ref), f.operator, f.value))
        return frame

    def measure(self, aggregation: str) -> Ref | None:
        if not self.plan.target_columns or self.plan.target_columns[0] == "*":
            return None
        ref = self.ref(self.plan.target_columns[0])
        if aggregation in ("sum", "average", "median") and family(self.kind(ref)) != "numeric":
            raise PlanError(f"{aggregation} needs a number; {ref} is {self.kind(ref).simpleString()}")
        return ref


def _named(catalog: Catalog, table: str) -> DataFrame:
    t = catalog.table(table)
    return t.df.select(*[F.col(f"`{c}`").alias(f"{t.name}.{c}") for c in t.df.columns])


def scope(catalog: Catalog, plan: Plan, table: str | None = None) -> Scope:
    """Joins left to right: each edge adds one table. An edge whose new table is its left one keeps its keyword, so a LEFT edge keeps the rows that are already there."""
    if not plan.joins:
        name = table or plan.table
        if not name:
            raise PlanError("the plan names no table")
        name = catalog.table(name).name
        return Scope(catalog, plan, [name], _named(catalog, name), [])
    base = catalog.table(plan.joins[0].left_table).name
    done, frame, left = [base], _named(catalog, base), []
    anti = _anti_edge(catalog, plan)
    for edge in plan.joins:
        a, b = catalog.resolve(f"{edge.left_table}.{edge.left_column}", [edge.left_table]), catalog.resolve(f"{edge.right_table}.{edge.right_column}", [edge.right_table])
        if a.table in done and b.table in done:
            raise PlanError(f"{a} = {b} joins tables that are already joined")
        if a.table not in done and b.table not in done:
            raise PlanError(f"{a} = {b} is not connected to the tables before it")
        new = b.table if a.table in done else a.table
        how = edge.join_type.lower()
        if how not in ("inner", "left", "right"):
            raise PlanError(f"unknown join type {edge.join_type!r}")
        if how == "left":
            left.append(new)
        if edge is anti:
            key = a if new == a.table else b
            other = b if new == a.table else a
            frame = frame.join(_named(catalog, new).select(col(key)), col(other) == col(key), "left_anti")
            continue  # the table is spent: nothing else of the plan names it
        frame = frame.join(_named(catalog, new), col(a) == col(b), how)
        done.append(new)
    return Scope(catalog, plan, done, frame, left)


def _anti_edge(catalog: Catalog, plan: Plan) -> Join | None:
    """The last edge, if it is LEFT and its new table serves only a test that its join column is null: an anti join."""
    edge = plan.joins[-1]
    if edge.join_type.lower() != "left" or len(plan.filters) == 0:
        return None
    new, column = edge.right_table, edge.right_column
    if any(new.lower() in (j.left_table.lower(), j.right_table.lower()) for j in plan.joins[:-1]) or edge.left_table.lower() == new.lower():
        return None
    tables = plan.tables()
    of = lambda text: catalog.resolve(text, tables, prefer=tables[0])
    tests = [f for f in plan.filters if of(f.column).table.lower() == new.lower()]
    named = [*plan.target_columns, *plan.group_by, *([plan.sort_column] if plan.sort_column and plan.sort_column.lower() not in VIRTUAL else [])]
    if len(tests) != 1 or tests[0].operator not in ("is_null", "null") or of(tests[0].column).column.lower() != column.lower():
        return None
    if not named and plan.intent not in ("count", "row_count") and plan.aggregation != "count":
        return None  # a star would show the other table's columns
    if any(t != "*" and of(t).table.lower() == new.lower() for t in named):
        return None
    return edge


def _filters(s: Scope) -> tuple[Filter, ...]:
    """The plan's filters but for the test that an anti join has settled; equal tests of a division become one list."""
    live = [t.lower() for t in s.tables]
    every = s.plan.tables() or s.tables
    kept = [f for f in s.plan.filters if s.catalog.resolve(f.column, every, prefer=every[0]).table.lower() in live]
    if not s.plan.require_all_filter_values:
        return tuple(kept)
    merged: dict[Ref, list] = {}
    for f in kept:
        if f.operator in ("equals", "in"):
            merged.setdefault(s.ref(f.column), []).extend(f.value if isinstance(f.value, (list, tuple)) else [f.value])
    rest = [f for f in kept if f.operator not in ("equals", "in")]
    return tuple(rest + [Filter(str(r), "in", list(dict.fromkeys(v))) for r, v in merged.items()])


def _division(s: Scope) -> list[tuple[Ref, list]]:
    """The columns of which a group must show every value asked for."""
    if not s.plan.require_all_filter_values:
        return []
    return [(s.ref(f.column), f.value) for f in _filters(s) if f.operator == "in" and len(f.value) > 1]


def _having(frame: DataFrame, plan: Plan) -> DataFrame:
    for f in plan.having_filters:
        if f.operator not in COMPARE or f.value is None or isinstance(f.value, (list, tuple)):
            raise PlanError(f"HAVING takes a comparison with one value, not {f.operator} {f.value!r}")
        frame = frame.where(getattr(F.col(VALUE), COMPARE[f.operator])(F.lit(f.value)))
    return frame


def _ordered(frame: DataFrame, c: Column | None, descending: bool, plan: Plan, nulls_first: bool = False, cap: bool = True, then: tuple[Column, ...] = ()) -> DataFrame:
    """Sort, limit or rank with ties, or the row cap. c: a column of frame; it may be a hidden one. then: what settles ties before a limit."""
    if plan.limit is not None and plan.limit <= 0:
        raise PlanError("the limit must be over 0")
    key = None if c is None else (c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if descending else c.asc_nulls_last()
    if plan.include_ties and plan.limit and key is not None:
        return _with_ties(frame, c, descending, nulls_first, key, plan.limit)
    if key is not None:
        frame = frame.orderBy(key, *(then if plan.limit else ()))
    if plan.limit:
        return frame.limit(plan.limit)
    return frame.limit(ROW_CAP) if cap else frame


def _with_ties(frame: DataFrame, c: Column, descending: bool, nulls_first: bool, key: Column, k: int) -> DataFrame:
    """The rows that sort no later than the k-th. A top-k finds its key as a scalar subquery, and a filter keeps the rest of the work where the rows are."""
    first = frame.select(c.alias("__key")).orderBy(F.col("__key").desc_nulls_first() if nulls_first else F.col("__key").desc_nulls_last() if descending else F.col("__key").asc_nulls_last()).limit(k)
    least = (F.min if descending else F.max)("__key").alias("edge")
    last = first.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("__key").alias("known"), least).alias("last")).scalar()
    reached = c >= last["edge"] if descending else c <= last["edge"]
    every = (last["n"] < k) if nulls_first else (last["known"] < k)  # the k-th is null, or there is none
    return frame.where(every | F.coalesce(reached, F.lit(False)) | (c.isNull() if nulls_first else F.lit(False))).orderBy(key)


def lookup(s: Scope) -> DataFrame:
    """Projection, filters, DISTINCT, sort, limit."""
    p = s.plan
    targets = [t for t in dict.fromkeys((*p.group_by, *p.target_columns)) if t != "*"] if s.joined else [t for t in p.target_columns if t != "*"]
    frame = s.where(s.frame, _filters(s))
    sort = s.ref(p.sort_column) if p.sort_column else None
    known = sort is not None and (p.intent == "ranking" or p.limit or p.sort_direction) and not any(s.ref(f.column) == sort and f.operator in ("is_null", "is_not_null") for f in _filters(s))
    if known:
        frame = frame.where(col(sort).isNotNull())
    if s.joined and (divide := _division(s)):
        ids = [col(Ref(s.tables[0], c)) for c in s.catalog.grain(s.tables[0])] if not p.group_by else [s.key(g) for g in p.group_by]
        # Groups that show every value, then the rows of those groups.
        shown = [F.count_distinct(F.when(col(r).isin(v), col(r))).alias(f"__all{i}") for i, (r, v) in enumerate(divide)]
        whole = frame.groupBy(*[c.alias(f"__group{i}") for i, c in enumerate(ids)]).agg(*shown)
        for i, (_, v) in enumerate(divide):
            whole = whole.where(F.col(f"__all{i}") == len(set(v)))
        frame = frame.join(whole, reduce(Column.__and__, [c.eqNullSafe(F.col(f"__group{i}")) for i, c in enumerate(ids)]), "left_semi")
    if targets:
        made = [(s.key(t) if t in p.group_by else col(s.ref(t))).alias(t) for t in targets]
    else:
        names = [c.split(".", 1)[1] for c in s.frame.columns]
        made = [F.col(f"`{c}`").alias(n if names.count(n) == 1 else c) for c, n in zip(s.frame.columns, names)]
    descending = (p.sort_direction or ("desc" if p.intent == "ranking" else "asc")).lower() == "desc"
    unique = p.distinct or p.intent == "distinct"
    if unique and sort is not None and targets and sort not in [s.ref(t) for t in targets]:
        raise PlanError(f"DISTINCT rows cannot be sorted by {sort}, which is not among them")
    if sort is None and p.include_ties and p.limit:
        sort = s.ref(targets[0]) if targets else Ref(s.tables[0], s.catalog.table(s.tables[0]).df.columns[0])
        descending = (p.sort_direction or "asc").lower() == "desc"
    if unique:
        refs = [s.ref(t) for t in targets]
        if s.joined and targets and not _division(s) and not p.group_by and len({r.table for r in refs}) == 1 and (found := _reduced(s, refs[0].table, {})) is not None:
            # All columns are of one table: the others are semi joins, and its key among them makes the rows distinct already.
            frame = (found[0].where(col(sort).isNotNull()) if known else found[0]).select(*made)
            if not s.catalog.is_unique(refs[0].table, tuple(r.column for r in refs)):
                frame = frame.distinct()
        else:
            frame = frame.select(*made).distinct()
        shown = None if sort is None else next((F.col(f"`{t}`") for t in targets if s.ref(t) == sort), F.col(f"`{sort.column}`"))
        return _ordered(frame, shown, descending, p, cap=s.capped)
    # Among equal sort keys the first table's grain decides, so that a top-k is the same rows each time.
    grain = [col(Ref(s.tables[0], c)).alias(f"__grain{i}") for i, c in enumerate(s.catalog.grain(s.tables[0]))] if sort is not None and p.limit and not p.include_ties else []
    frame = frame.select(*made, *([col(sort).alias("__sort")] if sort is not None else []), *grain)
    out = _ordered(frame, F.col("__sort") if sort is not None else None, descending, p, cap=s.capped, then=tuple(F.col(f"__grain{i}") for i in range(len(grain))))
    return out.drop("__sort", *[f"__grain{i}" for i in range(len(grain))])


def count(s: Scope) -> DataFrame:
    return s.where(s.frame, _filters(s)).agg(F.count(F.lit(1)).alias(VALUE))


def percentage(s: Scope) -> DataFrame:
    """Rows that match, in percent of all rows, in one scan; 0 for an empty table."""
    test = F.lit(True)
    for f in s.plan.filters:
        ref = s.ref(f.column)
        test = test & predicate(col(ref), s.kind(ref), f.operator, f.value)
    return s.frame.agg(F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)) * 100.0, F.lit(0.0)).alias(VALUE))


def _sorted_groups(s: Scope, frame: DataFrame) -> DataFrame:
    """Groups by their value, a key or the measure. Over one table NULLs stand as the database has them (first if descending); over joins last."""
    p = s.plan
    if not p.sort_column:
        return _ordered(frame, F.col(VALUE) if p.include_ties and p.limit else None, True, p, cap=s.joined and s.capped)
    name = p.sort_column
    by = F.col(VALUE)
    if name.lower() not in VIRTUAL and not any(name.lower() == t.lower() for t in p.target_columns):
        ref = s.ref(name) if not s.joined or _resolves(s, name) else None
        same = [g for g in p.group_by if ref is not None and s.ref(g) == ref]
        if same:
            by = F.col(f"`{same[0]}`")
        elif not s.joined:
            raise PlanError(f"groups cannot be sorted by {name!r}")
    return _ordered(frame, by, (p.sort_direction or "asc").lower() == "desc", p, nulls_first=not s.joined, cap=s.joined and s.capped, then=tuple(F.col(f"`{g}`") for g in p.group_by))


def _resolves(s: Scope, name: str) -> bool:
    try:
        return bool(s.ref(name))
    except PlanError:
        return False


def single_aggregate(s: Scope) -> DataFrame:
    """Scalar or grouped aggregate over one table. COUNT counts rows, whatever its target."""
    p = s.plan
    name = p.aggregation or "count"
    ref = s.measure(name)
    value = aggregate(name, None if name == "count" or ref is None else col(ref)).alias(VALUE)
    frame = s.where(s.frame, _filters(s))
    if name == "median" and not _division(s):
        keys = [s.key(g).alias(g) for g in p.group_by]
        out = median(frame.select(*keys, col(ref).alias("__measure")), list(p.group_by), "__measure")
        return _sorted_groups(s, _having(out, p)) if p.group_by else _having(out, p)
    if not p.group_by:
        return _having(frame.agg(value), p)
    checks = [F.count_distinct(F.when(col(r).isin(v), col(r))).alias(f"__all{i}") for i, (r, v) in enumerate(_division(s))]
    out = frame.groupBy(*[s.key(g).alias(g) for g in p.group_by]).agg(value, *checks)
    for i, (_, v) in enumerate(_division(s)):
        out = out.where(F.col(f"__all{i}") == len(set(v))).drop(f"__all{i}")
    return _sorted_groups(s, _having(out, p))


def keeps_grain(s: Scope, target: str) -> bool:
    """True if the joins give each row of target at most one row: every other table is reached by a key of its own."""
    reached, todo = {target.lower()}, [target.lower()]
    while todo:
        at = todo.pop()
        for j in s.plan.joins:
            for (t, _), (u, c) in (((j.left_table, j.left_column), (j.right_table, j.right_column)), ((j.right_table, j.right_column), (j.left_table, j.left_column))):
                if t.lower() == at and u.lower() not in reached and u.lower() in [x.lower() for x in s.tables]:
                    if j.join_type.lower() == "right" or not s.catalog.is_unique(u, (c,)):
                        return False
                    reached.add(u.lower())
                    todo.append(u.lower())
    return len(reached) == len(s.tables)


def _reduced(s: Scope, root: str, carried: dict[str, tuple[Ref, Column]]) -> tuple[DataFrame, bool] | None:
    """The rows of root that meet the filtered others over inner joins, with the carried columns of those (name: its reference, what to make of it), and whether each row of root stands there once for each of their values.

    A table that carries nothing is a semi join. Of one that carries something, join key and carried values are made distinct before
    the join, so nothing is multiplied by other columns. None where the joins are not all inner.
    """
    if any(j.join_type.lower() != "inner" for j in s.plan.joins) or len(s.tables) != len(s.plan.joins) + 1:
        return None
    filters: dict[str, list[Filter]] = {}
    for f in _filters(s):
        filters.setdefault(s.ref(f.column).table, []).append(f)
    edges: dict[str, list[tuple[Ref, Ref]]] = {t: [] for t in s.tables}
    for j in s.plan.joins:
        a, b = s.catalog.resolve(f"{j.left_table}.{j.left_column}", [j.left_table]), s.catalog.resolve(f"{j.right_table}.{j.right_column}", [j.right_table])
        edges[a.table].append((a, b))
        edges[b.table].append((b, a))

    def side(table: str, via: str | None) -> tuple[DataFrame, list[str], bool]:
        frame, names, once = s.where(_named(s.catalog, table), tuple(filters.get(table, ()))), [n for n, (r, _) in carried.items() if r.table == table], True
        if table != root:
            frame = frame.withColumns({n: carried[n][1] for n in names})
        for own, other in edges[table]:
            if other.table == via:
                continue
            below, more, single = side(other.table, table)
            if not more:
                frame = frame.join(below.select(col(other)), col(own) == col(other), "left_semi")
                continue
            kept = below.select(col(other), *[F.col(f"`{n}`") for n in more])
            whole = single and s.catalog.is_unique(other.table, (other.column,))
            frame = frame.join(kept if whole else kept.distinct(), col(own) == col(other))
            names, once = names + more, once and whole
        return frame, names, once

    frame, _, _ = side(root, None)
    return frame.withColumns({n: c for n, (r, c) in carried.items() if r.table == root}), s.catalog.is_unique(root, s.catalog.grain(root))


def joined_aggregate(s: Scope) -> DataFrame:
    """Aggregates that joins do not multiply: rows are told apart by the grain of the measure's table, per group, before they are aggregated.

    Where the joins cannot repeat a row of that table, nothing is made distinct. Over inner joins the other tables are reduced to
    what the groups need before they are joined, so only their keys and group values are ever made distinct.
    """
    p = s.plan
    name = p.aggregation or "count"
    ref = s.measure(name)
    if name != "count" and ref is None:
        raise PlanError(f"{name} needs a target column")
    target = ref.table if ref else s.tables[0]
    divide = _division(s)
    ids = [Ref(target, c) for c in s.catalog.grain(target)]
    if ref is None and p.group_by:
        ids = [Ref(t, c) for t in s.tables for c in s.catalog.grain(t)]
    elif ref is None and s.left_joined and s.left_joined[-1] in s.tables:
        null_test = any(f.operator in ("is_null", "null") and s.ref(f.column).table in s.left_joined for f in _filters(s))
        if not null_test:  # pairs of a row with what it met; with a test for null the rows alone count
            ids += [Ref(s.left_joined[-1], c) for c in s.catalog.grain(s.left_joined[-1])]
    pairs = len(ids) > len(s.catalog.grain(target))
    declared = all(s.catalog.is_unique(t, s.catalog.grain(t)) for t in {i.table for i in ids})
    unique = not divide and (declared or ref is not None) and keeps_grain(s, target) and not pairs
    unique = unique or pairs and declared and not divide and {i.table for i in ids} == set(s.tables)  # a row for each pairing of keys
    frame = None
    if not unique and not pairs:
        carried = {f"__g{i}": (s.ref(g), s.key(g)) for i, g in enumerate(p.group_by)} | {f"__div{i}": (r, col(r)) for i, (r, _) in enumerate(divide)}
        if (found := _reduced(s, target, carried)) is not None:
            frame, unique = found
            keys, tests = [F.col(f"__g{i}").alias(g) for i, g in enumerate(p.group_by)], [F.col(f"__div{i}") for i in range(len(divide))]
    if frame is None:
        frame = s.where(s.frame, _filters(s))
        keys, tests = [s.key(g).alias(g) for g in p.group_by], [col(r).alias(f"__div{i}") for i, (r, _) in enumerate(divide)]
    held = [col(i).alias(f"__id{n}") for n, i in enumerate(dict.fromkeys(ids))]
    rows = frame.select(*held, *keys, *([col(ref).alias("__measure")] if ref else []), *tests)
    if not unique:
        rows = rows.distinct()
    if name == "count":
        pair = ref is None and s.left_joined and pairs and not p.group_by
        counted = F.col("__measure") if ref else F.col(f"__id{len(ids) - 1}") if pair else F.lit(1)
        value = (F.count_distinct(counted) if p.distinct and ref else F.count(counted)).alias(VALUE)
    elif name == "median" and not divide:
        return _sorted_groups(s, _having(median(rows, list(p.group_by), "__measure"), p))
    else:
        value = aggregate(name, F.col("__measure")).alias(VALUE)
    checks = [F.count_distinct(F.when(F.col(f"__div{i}").isin(v), F.col(f"__div{i}"))).alias(f"__all{i}") for i, (_, v) in enumerate(divide)]
    out = rows.groupBy(*[F.col(f"`{g}`") for g in p.group_by]).agg(value, *checks) if p.group_by else rows.agg(value, *checks)
    for i, (_, v) in enumerate(divide):
        out = out.where(F.col(f"__all{i}") == len(set(v))).drop(f"__all{i}")
    return _sorted_groups(s, _having(out, p))


def derived(s: Scope) -> DataFrame:
    """An aggregate over groups' aggregates."""
    p = s.plan
    if p.aggregation not in ("sum", "average", "min", "max", "median"):
        raise PlanError(f"{p.aggregation!r} over groups is not provided")
    if not p.group_by:
        raise PlanError("an aggregate over groups needs its groups")
    inner = p.inner_aggregation or "count"
    ref = s.measure(inner)
    if inner == "count" and ref is not None and ref in [s.ref(g) for g in p.group_by]:
        ref = None
    if inner != "count" and ref is None:
        raise PlanError(f"{inner} needs a target column")
    value = aggregate(inner, None if ref is None else col(ref)).alias("metric")
    groups = _having(s.where(s.frame, _filters(s)).groupBy(*[s.key(g).alias(g) for g in p.group_by]).agg(value.alias(VALUE)), p)
    if p.aggregation == "median":
        return median(groups, [], VALUE)
    return groups.agg(aggregate(p.aggregation, F.col(VALUE).cast("double")).alias(VALUE))


def compile_plan(catalog: Catalog, plan: Plan, table: str | None = None, capped: bool = True) -> DataFrame:
    """The plan's result, lazily. Scalars are one row of one column; existence is a boolean, column names are rows. Unless capped, ROW_CAP does not hold."""
    if plan.intent == "unsupported":
        raise PlanError(plan.explanation or "the question cannot be answered from the catalog")
    if plan.intent in ("column_count", "column_names") and not plan.joins:
        t = catalog.table(table or plan.table or "")
        spark = t.df.sparkSession
        if plan.intent == "column_count":
            return spark.range(1).select(F.lit(len(t.df.columns)).cast("long").alias(VALUE))
        return spark.range(1).select(F.posexplode(F.array(*map(F.lit, t.df.columns))).alias("position", "column_name")).orderBy("position").select("column_name")
    s = replace(scope(catalog, plan, table), capped=capped)
    if plan.intent == "derived_aggregation":
        return derived(s)
    if plan.intent == "existence":
        return s.where(s.frame, _filters(s)).limit(1).agg((F.count(F.lit(1)) > 0).alias(VALUE))
    if plan.intent == "percentage":
        return percentage(s)
    if s.joined:
        return joined_aggregate(s) if plan.aggregation or plan.intent in ("count", "row_count") else lookup(s)
    if plan.intent == "aggregation" or plan.intent == "comparison" and plan.aggregation:
        return single_aggregate(s)
    if plan.intent == "count" and plan.group_by:
        return single_aggregate(s)
    if plan.intent in ("count", "row_count"):
        return count(s)
    if plan.intent in ("lookup", "distinct", "ranking", "filter", "comparison"):
        return lookup(s)
    raise PlanError(f"unknown intent {plan.intent!r}")
