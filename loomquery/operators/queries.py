"""The engine's queries over the test tables, each a plan beside the SQL that it should equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.plans.ir import Filter, Join, Plan
from loomquery.sources.tpch import catalog

from . import followup, relations, vectors
from .compile import VALUE, compile_plan

V = "aggregation_value"
#: Edges of the test tables.
LO = Join("lineitem", "l_orderkey", "orders", "o_orderkey")
OC = Join("orders", "o_custkey", "customer", "c_custkey")
CO = Join("customer", "c_custkey", "orders", "o_custkey")
OL = Join("orders", "o_orderkey", "lineitem", "l_orderkey")
CN = Join("customer", "c_nationkey", "nation", "n_nationkey")
NR = Join("nation", "n_regionkey", "region", "r_regionkey")
DL = Join("documents", "doc_id", "labels", "doc_id")


def left(j: Join, how: str = "left") -> Join:
    return Join(j.left_table, j.left_column, j.right_table, j.right_column, how)


def agg(aggregation: str, target: str | None = None, **more) -> Plan:
    return Plan("aggregation", aggregation=aggregation, target_columns=(target,) if target else (), **more)


def look(*targets: str, intent: str = "lookup", **more) -> Plan:
    return Plan(intent, target_columns=targets, **more)


def f(column: str, operator: str, value=None) -> tuple[Filter, ...]:
    return (Filter(column, operator, value),)


#: name: (plan, table or None, decimals of doubles or None, SQL).
CASES: dict[str, tuple[Plan, str | None, int | None, str]] = {}


def case(name: str, plan: Plan, table: str | None, sql: str, digits: int | None = None) -> None:
    CASES[name] = (plan, table, digits, sql)


case("q_lookup_projection", look("o_orderkey", "orders.o_orderstatus", filters=f("o_orderkey", "less_than", 500)), "orders", 'SELECT o_orderkey, o_orderstatus AS "orders.o_orderstatus" FROM orders WHERE o_orderkey < 500')
case("q_lookup_star_limit_sorted", look(sort_column="o_orderkey", sort_direction="desc", limit=25), "orders", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 25")
case("q_row_cap", look("l_orderkey", filters=f("l_orderkey", "greater_than", 0)), "lineitem", "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem WHERE l_orderkey > 0 LIMIT 5000)")
for name, column, op, value, sql in (
    ("eq", "c_mktsegment", "equals", "BUILDING", "c_mktsegment = 'BUILDING'"), ("neq", "c_mktsegment", "not_equals", "BUILDING", "c_mktsegment <> 'BUILDING'"),
    ("gt", "c_acctbal", "greater_than", 5000, "c_acctbal > 5000"), ("ge", "c_custkey", "greater_than_or_equal", 700, "c_custkey >= 700"), ("lt", "c_acctbal", "less_than", 100.5, "c_acctbal < 100.5"), ("le", "c_custkey", "less_than_or_equal", 70, "c_custkey <= 70"),
    ("between", "c_custkey", "between", [10, 90], "c_custkey BETWEEN 10 AND 90"), ("in", "c_nationkey", "in", [1, 5, 7], "c_nationkey IN (1, 5, 7)"), ("not_in", "c_nationkey", "not_in", [1, 5, 7], "c_nationkey NOT IN (1, 5, 7)"),
    ("contains", "c_name", "contains", "11", "c_name LIKE '%11%'"), ("starts", "c_mktsegment", "starts_with", "B", "c_mktsegment LIKE 'B%'"), ("ends", "c_name", "ends_with", "7", "c_name LIKE '%7'"), ("wildcard", "c_name", "contains", "1_1", "c_name LIKE '%1_1%'"),
    ("is_null", "c_name", "is_null", None, "c_name IS NULL"), ("is_not_null", "c_name", "equals", "", "c_name = ''"), ("not_null", "c_mktsegment", "is_not_null", None, "c_mktsegment IS NOT NULL"),
):
    case(f"q_filter_{name}", look("c_custkey", "c_name", filters=f(column, op, value)), "customer", f"SELECT c_custkey, c_name FROM customer WHERE {sql}")
case("q_filter_year", Plan("count", filters=f("o_orderdate", "year", 1996)), "orders", f"SELECT count(*) AS {V} FROM orders WHERE year(o_orderdate) = 1996")
case("q_filter_year_equals", Plan("count", filters=f("o_orderdate", "equals", 1997)), "orders", f"SELECT count(*) AS {V} FROM orders WHERE year(o_orderdate) = 1997")
case("q_filter_date_range", Plan("count", filters=(Filter("l_shipdate", "greater_than_or_equal", "1995-01-01"), Filter("l_shipdate", "less_than", "1995-07-01"))), "lineitem", f"SELECT count(*) AS {V} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01'")
case("q_row_count", Plan("row_count"), "lineitem", f"SELECT count(*) AS {V} FROM lineitem")
case("q_count_filtered", Plan("count", filters=f("l_returnflag", "equals", "R")), "lineitem", f"SELECT count(*) AS {V} FROM lineitem WHERE l_returnflag = 'R'")
case("q_column_count", Plan("column_count"), "orders", f"SELECT CAST(6 AS BIGINT) AS {V}")
case("q_column_names", Plan("column_names"), "nation", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name")
case("q_existence", Plan("existence", filters=f("o_totalprice", "greater_than", 100)), "orders", f"SELECT count(*) > 0 AS {V} FROM orders WHERE o_totalprice > 100")
case("q_percentage", Plan("percentage", filters=f("l_returnflag", "equals", "R")), "lineitem", f"SELECT round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS {V} FROM lineitem", 6)
for name, sql in (("sum", "sum(l_extendedprice)"), ("average", "avg(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("median", "quantile_cont(l_extendedprice, 0.5)")):
    case(f"q_{name}", agg(name, "l_extendedprice"), "lineitem", f"SELECT round({sql}, 4) AS {V} FROM lineitem", 4)
    case(f"q_group_{name}", agg(name, "l_extendedprice", group_by=("l_returnflag",)), "lineitem", f"SELECT l_returnflag, round({sql}, 4) AS {V} FROM lineitem GROUP BY ALL", 4)
case("q_aggregation_count", agg("count", filters=f("l_quantity", "less_than", 10)), "lineitem", f"SELECT count(*) AS {V} FROM lineitem WHERE l_quantity < 10")
case("q_min_date", agg("min", "o_orderdate"), "orders", f"SELECT min(o_orderdate) AS {V} FROM orders")
case("q_group_count", agg("count", group_by=("o_orderpriority",)), "orders", f"SELECT o_orderpriority, count(*) AS {V} FROM orders GROUP BY ALL")
case("q_group_multi_key", agg("sum", "l_quantity", group_by=("l_returnflag", "l_linestatus"), filters=f("l_shipdate", "less_than_or_equal", "1998-09-02")), "lineitem", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS {V} FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL", 2)
for op, sign, value in (("equals", "=", 3), ("not_equals", "<>", 3), ("greater_than", ">", 12), ("greater_than_or_equal", ">=", 12), ("less_than", "<", 6), ("less_than_or_equal", "<=", 6)):
    case(f"q_having_{op}", agg("count", group_by=("o_custkey",), having_filters=f("count", op, value)), "orders", f"SELECT o_custkey, count(*) AS {V} FROM orders GROUP BY ALL HAVING count(*) {sign} {value}")
case("q_group_require_all", agg("count", group_by=("o_custkey",), filters=f("o_orderstatus", "in", ["F", "O", "P"]), require_all_filter_values=True), "orders", f"SELECT o_custkey, count(*) AS {V} FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 3")
case("q_require_all_equals", agg("count", group_by=("o_custkey",), filters=(Filter("o_orderstatus", "equals", "F"), Filter("o_orderstatus", "equals", "O")), require_all_filter_values=True), "orders", f"SELECT o_custkey, count(*) AS {V} FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 2")
for g in ("day", "week", "month", "quarter", "year"):
    case(f"q_group_{g}", agg("count", group_by=("ts",), group_by_granularity=g), "events", f"SELECT CAST(date_trunc('{g}', ts) AS DATE) AS ts, count(*) AS {V} FROM events GROUP BY ALL")
case("q_top_k", look("c_custkey", "c_acctbal", intent="ranking", sort_column="c_acctbal", sort_direction="desc", limit=10), "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
case("q_top_k_ties", look("p_partkey", "p_size", intent="ranking", sort_column="p_size", sort_direction="desc", limit=10, include_ties=True), "part", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
case("q_ties_without_sort", look("p_size", "p_partkey", limit=3, include_ties=True), "part", "SELECT p_size, p_partkey FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 3")
case("q_group_top", agg("sum", "o_totalprice", group_by=("o_custkey",), sort_column="sum", sort_direction="desc", limit=5), "orders", f"SELECT o_custkey, round(sum(o_totalprice), 2) AS {V} FROM orders GROUP BY ALL ORDER BY sum(o_totalprice) DESC LIMIT 5", 2)
case("q_group_top_ties", agg("count", group_by=("o_custkey",), sort_column="count", sort_direction="desc", limit=5, include_ties=True), "orders", f"SELECT o_custkey, count(*) AS {V} FROM orders GROUP BY o_custkey QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5")
case("q_group_sorted_by_key", agg("count", group_by=("o_custkey",), sort_column="o_custkey", sort_direction="asc", limit=7), "orders", f"SELECT o_custkey, count(*) AS {V} FROM orders GROUP BY ALL ORDER BY o_custkey LIMIT 7")
case("q_distinct", look("o_orderpriority", intent="distinct"), "orders", "SELECT DISTINCT o_orderpriority FROM orders")
case("q_distinct_multi", look("l_returnflag", "l_linestatus", distinct=True, sort_column="l_returnflag", sort_direction="asc"), "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
case("q_join_inner", look("o_orderkey", "c_name", joins=(OC,), filters=f("o_totalprice", "greater_than", 400000)), None, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
case("q_join_left", look("o_orderkey", "l_linenumber", joins=(left(OL),), filters=f("o_orderkey", "less_than", 300)), None, "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 300")
case("q_join_right", look("l_linenumber", "o_orderkey", joins=(left(LO, "right"),), filters=f("o_orderkey", "less_than", 300)), None, "SELECT l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey < 300")
case("q_join_3way", look("c_custkey", "n_name", "r_name", joins=(CN, NR), filters=f("c_acctbal", "greater_than", 8000)), None, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 8000")
case("q_join_reverse_edge", look("o_orderkey", "c_custkey", joins=(left(NR), left(CN), left(OC)), filters=(Filter("r_name", "equals", "ASIA"), Filter("o_orderkey", "less_than", 400))), None, "SELECT o_orderkey, c_custkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND o_orderkey < 400")
case("q_join_star", look(joins=(NR,)), None, "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
case("q_join_star_clash", look(joins=(DL,), filters=f("documents.doc_id", "less_than", 50), sort_column="documents.doc_id", limit=10), None, 'SELECT d.doc_id AS "documents.doc_id", text, lang, source, n_chars, l.doc_id AS "labels.doc_id", quality, toxic FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id < 50 ORDER BY d.doc_id LIMIT 10')
case("q_join_anti", look("o_orderkey", joins=(left(OL),), filters=f("l_orderkey", "is_null")), None, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
case("q_join_anti_count", Plan("count", joins=(left(OL),), filters=f("l_orderkey", "is_null")), None, f"SELECT count(*) AS {V} FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
case("q_join_anti_other_column", Plan("count", joins=(left(DL),), filters=f("quality", "is_null")), None, f"SELECT count(*) AS {V} FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
case("q_join_semi", look("c_custkey", distinct=True, joins=(CO,), filters=f("o_totalprice", "greater_than", 300000)), None, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
case("q_join_semi_count", Plan("count", joins=(CO,), filters=f("o_totalprice", "greater_than", 300000)), None, f"SELECT count(*) AS {V} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
case("q_join_left_count", Plan("count", joins=(left(CO),), filters=f("c_custkey", "less_than", 200)), None, f"SELECT count(o_orderkey) AS {V} FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey < 200")
# A left join's nulls.
case("q_filter_null_in_join", look("documents.doc_id", "lang", "quality", joins=(left(DL),), filters=f("quality", "is_null")), None, 'SELECT d.doc_id AS "documents.doc_id", lang, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL')
case("q_filter_not_null_in_join", look("documents.doc_id", "quality", joins=(left(DL),), filters=f("quality", "is_not_null")), None, 'SELECT d.doc_id AS "documents.doc_id", quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL')
case("q_filter_null_word", look("documents.doc_id", joins=(left(DL),), filters=f("toxic", "equals", None)), None, 'SELECT d.doc_id AS "documents.doc_id" FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS NULL')
case("q_sort_leaves_nulls_out", look("documents.doc_id", "quality", intent="ranking", joins=(left(DL),), sort_column="quality", sort_direction="asc", limit=5000), None, 'SELECT d.doc_id AS "documents.doc_id", quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL ORDER BY quality, d.doc_id LIMIT 5000')
case("q_group_sorted_nulls_last", agg("count", "documents.doc_id", joins=(left(DL),), group_by=("quality",), sort_column="quality", sort_direction="asc", limit=3), None, f"SELECT quality, count(*) AS {V} FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY quality ORDER BY quality NULLS LAST LIMIT 3")
case("q_join_having_without_groups", agg("count", "o_orderkey", joins=(OC,), having_filters=f("count", "greater_than", 10)), None, f"SELECT count(o_orderkey) AS {V} FROM orders JOIN customer ON o_custkey = c_custkey HAVING count(*) > 10")
PARENT = "FROM (SELECT DISTINCT o_orderkey, o_totalprice AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25)"
for name, sql in (("sum", "sum(m)"), ("average", "avg(m)"), ("min", "min(m)"), ("max", "max(m)"), ("median", "quantile_cont(m, 0.5)"), ("count", "count(m)")):
    case(f"q_fanout_parent_{name}", agg(name, "o_totalprice", joins=(OL,), filters=f("l_quantity", "greater_than", 25)), None, f"SELECT {sql if name == 'count' else f'round({sql}, 4)'} AS {V} {PARENT}", 4)
case("q_fanout_grouped_sum", agg("sum", "o_totalprice", joins=(OL,), group_by=("l_returnflag",)), None, f"SELECT l_returnflag, round(sum(m), 2) AS {V} FROM (SELECT DISTINCT o_orderkey, l_returnflag, o_totalprice AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY ALL", 2)
case("q_fanout_grouped_median", agg("median", "o_totalprice", joins=(OL,), group_by=("l_returnflag",)), None, f"SELECT l_returnflag, round(quantile_cont(m, 0.5), 4) AS {V} FROM (SELECT DISTINCT o_orderkey, l_returnflag, o_totalprice AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY ALL", 4)
case("q_child_sum_preserved", agg("sum", "l_extendedprice", joins=(LO, OC), group_by=("c_mktsegment",)), None, f"SELECT c_mktsegment, round(sum(l_extendedprice), 2) AS {V} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL", 2)
case("q_fanout_having", agg("sum", "c_acctbal", joins=(CO,), group_by=("c_mktsegment",), having_filters=f("sum", "greater_than", 1000)), None, f"SELECT c_mktsegment, round(sum(m), 2) AS {V} FROM (SELECT DISTINCT c_custkey, c_mktsegment, c_acctbal AS m FROM customer JOIN orders ON o_custkey = c_custkey) GROUP BY ALL HAVING sum(m) > 1000", 2)
case("q_join_count_distinct", agg("count", "o_custkey", distinct=True, joins=(OC,), group_by=("c_mktsegment",)), None, f"SELECT c_mktsegment, count(DISTINCT o_custkey) AS {V} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
case("q_join_group_count", agg("count", joins=(OC,), group_by=("c_mktsegment",), sort_column="count", sort_direction="desc"), None, f"SELECT c_mktsegment, count(*) AS {V} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
case("q_join_group_top_ties", agg("count", joins=(OC,), group_by=("c_custkey",), limit=3, include_ties=True), None, f"SELECT c_custkey, count(*) AS {V} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 3")
case("q_join_group_month", agg("sum", "l_quantity", joins=(LO,), group_by=("o_orderdate",), group_by_granularity="month"), None, f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate, round(sum(l_quantity), 2) AS {V} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL", 2)
case("q_join_require_all", agg("count", "o_orderkey", joins=(CO,), group_by=("c_custkey",), filters=f("o_orderpriority", "in", ["1-URGENT", "2-HIGH", "5-LOW"]), require_all_filter_values=True), None, f"SELECT c_custkey, count(DISTINCT o_orderkey) AS {V} FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ALL HAVING count(DISTINCT o_orderpriority) = 3")
for outer, sql in (("average", "avg(m)"), ("sum", "sum(m)"), ("min", "min(m)"), ("max", "max(m)"), ("median", "quantile_cont(m, 0.5)")):
    case(f"q_derived_{outer}", Plan("derived_aggregation", aggregation=outer, inner_aggregation="count", group_by=("o_custkey",)), "orders", f"SELECT round(CAST({sql} AS DOUBLE), 4) AS {V} FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM orders GROUP BY o_custkey)", 4)
for inner, sql in (("sum", "sum(o_totalprice)"), ("average", "avg(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), ("median", "quantile_cont(o_totalprice, 0.5)")):
    case(f"q_derived_inner_{inner}", Plan("derived_aggregation", aggregation="average", inner_aggregation=inner, target_columns=("o_totalprice",), group_by=("o_custkey",)), "orders", f"SELECT round(avg(m), 4) AS {V} FROM (SELECT {sql} AS m FROM orders GROUP BY o_custkey)", 4)
case("q_derived_joined", Plan("derived_aggregation", aggregation="max", inner_aggregation="count", target_columns=("l_orderkey",), group_by=("c_custkey",), joins=(CO, OL)), None, f"SELECT CAST(max(m) AS DOUBLE) AS {V} FROM (SELECT count(l_orderkey) AS m FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey)", 4)


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    kinds = dict(df.dtypes)
    return df if digits is None else df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kinds[c] == "double" and c == VALUE else F.col(f"`{c}`") for c in df.columns])


def run_case(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, table, digits, _ = CASES[name]
    tables = plan.tables() or [table]
    df = compile_plan(catalog(spark, sf_dir, tables), plan, table, capped=name == "q_row_cap")
    if name == "q_row_cap":  # which rows a cap keeps is open; how many is not
        df = df.agg(F.count(F.lit(1)).alias("n"))
    return rounded(df, digits)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_case("q_group_sum", spark, sf_dir)


def row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).row_counts()


TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(run_case, n) for n in CASES}
QUERIES |= {"q_row_stats_all_tables": row_stats} | relations.QUERIES | vectors.QUERIES | followup.QUERIES
ORACLE = {n: c[3] for n, c in CASES.items()}
ORACLE |= {"q_row_stats_all_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TPCH)} | relations.ORACLE | vectors.ORACLE | followup.ORACLE
