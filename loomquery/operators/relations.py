"""Finding and checking relationships: names propose, one distributed overlap count disposes, a graph connects."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.functions.types import family
from loomquery.plans.cache import JsonCache
from loomquery.sources.catalog import Catalog
from loomquery.sources.tpch import catalog

#: Fixed values of the scores, with those in score().
ID_SUFFIXES = ("_id", "_key", "_code", "_number", "_no")
ID_NAMES = {"id", "key", "code", "identifier"}
LEAST_SCORE, HOP, NEEDED, UNNEEDED, CONTAINER, TIE = 0.45, 0.75, (0.20, 0.40), 0.15, 0.15, 0.08
CONTAINERS = ("site_id", "tenant_id", "client_id")


@dataclass(frozen=True)
class Edge:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    confidence: float
    status: str = "candidate"

    def turned(self) -> Edge:
        return Edge(self.right_table, self.right_column, self.left_table, self.left_column, self.confidence, self.status)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def stem(name: str) -> str:
    """A column's name without its identifier suffix."""
    whole = snake(name)
    return next((whole[: -len(s)] for s in ID_SUFFIXES if whole.endswith(s) and len(whole) > len(s)), whole)


def is_identifier(table: str, column: str, cat: Catalog) -> bool:
    low = snake(column)
    return column in cat.table(table).primary_key or low.endswith(ID_SUFFIXES) or low in ID_NAMES


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Families must agree; whole numbers go with whole numbers only."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return family(a) == family(b) and family(a) in ("numeric", "string", "temporal", "boolean") and (family(a) != "numeric" or isinstance(a, whole) == isinstance(b, whole))


def score(cat: Catalog, lt: str, lc: str, rt: str, rc: str) -> float:
    """How far names, keys and types speak for lt.lc = rt.rc, from 0 to 1."""
    left, right = cat.table(lt), cat.table(rt)
    lf, rf = left.df.schema[lc], right.df.schema[rc]
    if not comparable(lf.dataType, rf.dataType):
        return 0.0
    ids = is_identifier(lt, lc, cat), is_identifier(rt, rc, cat)
    if lc.lower() == rc.lower():
        total = 0.45
    elif stem(lc) == stem(rc):
        total = 0.35
    elif any(ids) and any(len(t) > 2 for t in set(stem(lc).split("_")) & set(stem(rc).split("_"))):
        total = 0.25
    else:
        return 0.0
    total += 0.15 * all(ids) + 0.20 * (lc in left.primary_key) + 0.20 * (rc in right.primary_key) + 0.05 * (not lf.nullable) + 0.05 * (not rf.nullable)
    return min(1.0, total)


def candidates(cat: Catalog) -> list[Edge]:
    """Pairs of identifier columns that score enough, best first. Columns meet through their tokens, not all with all."""
    by_token: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for t in cat.items.values():
        for c in t.df.columns:
            if is_identifier(t.name, c, cat):
                for token in {snake(c), stem(c), *stem(c).split("_")}:
                    by_token[token].add((t.name, c))
    pairs = {tuple(sorted(p)) for held in by_token.values() for p in combinations(sorted(held), 2) if p[0][0] != p[1][0]}
    found = [Edge(a, b, c, d, s) for (a, b), (c, d) in sorted(pairs) if (s := score(cat, a, b, c, d)) >= LEAST_SCORE]
    return sorted(found, key=lambda e: (-e.confidence, e.left_table, e.left_column, e.right_table, e.right_column))


def overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """left_rows, right_rows, left_distinct, right_distinct (without null) and matching distinct values: one shuffle, pre-aggregated."""
    kind = lambda df, c: df.schema[c].dataType
    wide = "decimal(38,0)" if family(kind(left, left_column)) == "numeric" and kind(left, left_column) != kind(right, right_column) else None

    def side(df: DataFrame, c: str, a: int, b: int) -> DataFrame:
        v: Column = F.col(f"`{c}`")
        return df.select((v.cast(wide) if wide else v).alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b"))

    values = side(left, left_column, 1, 0).unionByName(side(right, right_column, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    here = F.col("v").isNotNull()
    of = lambda test, name: F.coalesce(F.count_if(test), F.lit(0)).alias(name)
    return values.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("right_rows"),
        of(here & (F.col("a") > 0), "left_distinct"), of(here & (F.col("b") > 0), "right_distinct"), of(here & (F.col("a") > 0) & (F.col("b") > 0), "matching"),
    )


def judge(edge: Edge, counts: dict[str, int]) -> Edge:
    """The edge with what the data say of it: insufficient_data, rejected or validated, and a confidence that weighs both."""
    least = min(counts["left_distinct"], counts["right_distinct"])
    if not counts["left_rows"] or not counts["right_rows"] or not least:
        status, sure = "insufficient_data", edge.confidence
    elif not counts["matching"] or counts["matching"] < 2 and least > 1:
        status, sure = "rejected", 0.0
    else:
        status, sure = "validated", round(min(1.0, 0.3 * edge.confidence + 0.7 * counts["matching"] / least), 3)
    return Edge(edge.left_table, edge.left_column, edge.right_table, edge.right_column, sure, status)


def overlaps(cat: Catalog, edges: list[Edge]) -> list[dict[str, int]]:
    """What overlap counts, for many candidates in one job: each table is read once, its values go out by candidate, and are counted by candidate and value, then by candidate."""
    sides: dict[str, list[Column]] = defaultdict(list)
    for i, e in enumerate(edges):
        kinds = [cat.table(t).df.schema[c].dataType for t, c in ((e.left_table, e.left_column), (e.right_table, e.right_column))]
        wide = "decimal(38,0)" if family(kinds[0]) == "numeric" and kinds[0] != kinds[1] else None
        for table, column, left in ((e.left_table, e.left_column, 1), (e.right_table, e.right_column, 0)):
            v = F.col(f"`{column}`")
            sides[table].append(F.struct(F.lit(i).alias("edge"), (v.cast(wide) if wide else v).cast("string").alias("v"), F.lit(left).cast("long").alias("a"), F.lit(1 - left).cast("long").alias("b")))
    rows = reduce(DataFrame.unionByName, [cat.table(t).df.select(F.explode(F.array(*s)).alias("x")).select("x.*") for t, s in sides.items()])
    values = rows.groupBy("edge", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    here, left, right = F.col("v").isNotNull(), F.col("a") > 0, F.col("b") > 0
    made = values.groupBy("edge").agg(
        F.sum("a").alias("left_rows"), F.sum("b").alias("right_rows"), F.count_if(here & left).alias("left_distinct"), F.count_if(here & right).alias("right_distinct"), F.count_if(here & left & right).alias("matching")
    )
    found = {r["edge"]: r.asDict() for r in made.collect()}  # a row a candidate
    none = dict.fromkeys(("left_rows", "right_rows", "left_distinct", "right_distinct", "matching"), 0)
    return [found.get(i, none) for i in range(len(edges))]


def _confirmed(cat: Catalog, edges: list[Edge]) -> list[Edge]:
    cat.validated |= {(e.left_table, e.left_column, e.right_table, e.right_column): e.confidence for e in edges if e.status == "validated"}
    return edges


def discover(cat: Catalog, cache: JsonCache | None = None) -> list[Edge]:
    """Candidates checked against the data. Errors are raised, not remembered; a cache keeps the verdicts under the catalog's fingerprint."""
    shape = cat.fingerprint()
    if cache is not None and (held := cache.read().get(shape)) is not None:
        out = [Edge(**e) for e in held]
        return _confirmed(cat, out)
    edges = candidates(cat)
    counts = overlaps(cat, edges) if edges else []
    out = _confirmed(cat, [judge(e, c) for e, c in zip(edges, counts)])
    if cache is not None:
        cache.put(shape, [asdict(e) for e in out])
    return out


class Graph:
    """Tables and the edges between them; small, on the driver."""

    def __init__(self, edges: list[Edge]) -> None:
        self.near: dict[str, list[Edge]] = defaultdict(list)
        for e in edges:
            if e.status in ("declared", "confirmed", "validated"):
                self.near[e.left_table].append(e)
                self.near[e.right_table].append(e.turned())

    def ambiguous(self, start: str, end: str, hops: int = 3) -> bool:
        """True if several shortest paths connect the two."""
        lengths = sorted(len(p) for p in self.paths(start, end, hops))
        return len(lengths) > 1 and lengths[0] == lengths[1]

    def bridges(self, start: str, end: str) -> list[str]:
        """Tables that connect two which no edge does."""
        return sorted({p[0].right_table for p in self.paths(start, end, 2) if len(p) == 2})

    @classmethod
    def known(cls, cat: Catalog) -> Graph:
        """Declared edges and those that data has confirmed."""
        declared = cls.declared(cat)
        pairs = {frozenset(((e.left_table, e.left_column), (e.right_table, e.right_column))) for held in declared.near.values() for e in held}
        more = [Edge(a, b, c, d, sure, "validated") for (a, b, c, d), sure in sorted(cat.validated.items()) if frozenset(((a, b), (c, d))) not in pairs]
        return cls([e for held in declared.near.values() for e in held if e.left_table < e.right_table] + more)

    @classmethod
    def declared(cls, cat: Catalog) -> Graph:
        return cls([Edge(f.table, f.columns[0], f.parent, f.parent_columns[0], 1.0, "declared") for f in cat.foreign_keys if len(f.columns) == 1])

    def paths(self, start: str, end: str, hops: int = 3) -> list[list[Edge]]:
        """All simple paths of at most so many hops; of parallel edges the surest."""
        out: list[list[Edge]] = []

        def go(at: str, path: list[Edge], seen: set[str]) -> None:
            if at == end:
                out.append(path)
                return
            if len(path) == hops:
                return
            best: dict[str, Edge] = {}
            for e in self.near[at]:
                if e.right_table not in seen and (e.right_table not in best or e.confidence > best[e.right_table].confidence):
                    best[e.right_table] = e
            for t, e in sorted(best.items()):
                go(t, [*path, e], seen | {t})

        go(start, [], {start})
        return out

    def best_path(self, start: str, end: str, through: set[str] = frozenset(), hints: set[str] = frozenset(), hops: int = 3) -> list[Edge] | None:
        """The path of the highest score; among scores within TIE of the best, the fewest hops."""
        if start == end:
            return []
        found = self.paths(start, end, hops)

        def worth(path: list[Edge]) -> float:
            total = HOP ** (len(path) - 1)
            for e in path:
                total *= e.confidence
            inner = {e.right_table for e in path[:-1]}
            if through:
                lost = through - inner
                total += -NEEDED[1] * len(lost) if lost else NEEDED[0]
            total -= UNNEEDED * len(inner - through - hints)
            if through or len(found) > 1:
                total -= CONTAINER * sum(all(any(c in x.lower() for c in CONTAINERS) for x in (e.left_column, e.right_column)) for e in path)
            return round(max(0.0, total), 3)

        if not found:
            return None
        ranked = [(worth(p), p) for p in found]
        top = max(w for w, _ in ranked)
        return min((x for x in ranked if top - x[0] <= TIE), key=lambda x: (len(x[1]), -x[0]))[1]

    def connect(self, tables: list[str]) -> list[Edge] | None:
        """Edges that connect the tables, grown from the first by the shortest best path."""
        if not tables:
            return []
        joined, edges = {tables[0]}, []
        for t in tables[1:]:
            if t in joined:
                continue
            options = [p for s in sorted(joined) if (p := self.best_path(s, t)) is not None]
            if not options:
                return None
            for e in min(options, key=len):
                if e.right_table not in joined:
                    edges.append(e)
                    joined.add(e.right_table)
        return edges


def _overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalog(spark, sf_dir, ["documents", "labels"])
    return overlap(cat.table("documents").df, "doc_id", cat.table("labels").df, "doc_id")


def _overlap_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalog(spark, sf_dir, ["customer", "nation"])
    return overlap(cat.table("customer").df, "c_nationkey", cat.table("nation").df, "n_nationkey")


def _oracle(a: str, x: str, b: str, y: str) -> str:
    return f"SELECT (SELECT count(*) FROM {a}) AS left_rows, (SELECT count(*) FROM {b}) AS right_rows, (SELECT count(DISTINCT {x}) FROM {a}) AS left_distinct, (SELECT count(DISTINCT {y}) FROM {b}) AS right_distinct, (SELECT count(DISTINCT {x}) FROM {a} WHERE {x} IN (SELECT {y} FROM {b})) AS matching"


QUERIES = {"q_rel_overlap_stats": _overlap_query, "q_rel_overlap_nation": _overlap_mixed}
ORACLE = {"q_rel_overlap_stats": _oracle("documents", "doc_id", "labels", "doc_id"), "q_rel_overlap_nation": _oracle("customer", "c_nationkey", "nation", "n_nationkey")}
