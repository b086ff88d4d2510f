"""Hand-computed fixtures: fan-out, nulls, ties, dates, names; the planner with a stub client; plans that Spark sees."""

import datetime as dt
import json

import pytest

from loomquery.errors import AmbiguousColumn, ContractError, PlanError
from loomquery.operators.compile import compile_plan, keeps_grain, scope
from loomquery.operators.followup import eligible, follow_up
from loomquery.operators.relations import Edge, Graph, candidates, discover, judge, overlap
from loomquery.operators.vectors import cosine_top_k, embed, murmur3
from loomquery.plans import planner, router, select
from loomquery.plans.cache import PlanCache, canonical
from loomquery.plans.ir import Filter, Join, Plan
from loomquery.plans.validate import to_contract, validate
from loomquery.service import Engine
from loomquery.sources.catalog import Catalog, ForeignKey

PO = Join("customers", "customer_id", "orders", "customer_id")


@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.createDataFrame([(1, "Ann", 100.0, "gold"), (2, "Bo_b", 50.0, None), (3, "C%c", None, "gold"), (4, "Dee", 50.0, "iron")], "customer_id int, name string, balance double, status string")
    day = dt.datetime
    orders = spark.createDataFrame([(10, 1, 5.0, "new", day(2024, 3, 31)), (11, 1, 5.0, "old", day(2024, 4, 1)), (12, 1, 7.0, "new", day(2024, 6, 30)), (13, 2, None, "old", day(2023, 12, 31)), (14, 2, 9.0, "new", None)], "order_id int, customer_id int, amount double, status string, placed timestamp_ntz")
    empty = spark.createDataFrame([], "archive_id int, note string")
    return Catalog.of({"customers": customers, "orders": orders, "archive": empty}, {"customers": ("customer_id",), "orders": ("order_id",)}, (ForeignKey("orders", ("customer_id",), "customers", ("customer_id",)),))


def scalar(shop, plan, table=None):
    return compile_plan(shop, plan, table).first()[0]


def test_parent_measures_are_not_multiplied(shop):
    plan = Plan("aggregation", aggregation="sum", target_columns=("balance",), joins=(PO,))
    assert scalar(shop, plan) == 150.0
    assert scalar(shop, plan.with_(aggregation="average")) == 75.0
    assert scalar(shop, Plan("count", joins=(PO,))) == 2
    # Once for each customer and order status.
    grouped = compile_plan(shop, plan.with_(group_by=("orders.status",)))
    assert {r["orders.status"]: r["aggregation_value"] for r in grouped.collect()} == {"new": 150.0, "old": 150.0}


def test_child_measures_keep_equal_rows_without_a_distinct(shop):
    plan = Plan("aggregation", aggregation="sum", target_columns=("amount",), joins=(PO,), group_by=("name",))
    df = compile_plan(shop, plan)
    assert {r["name"]: r["aggregation_value"] for r in df.collect()} == {"Ann": 17.0, "Bo_b": 9.0}
    assert keeps_grain(scope(shop, plan), "orders") and not keeps_grain(scope(shop, plan), "customers")


def test_left_and_anti_counts(shop):
    left = Join("customers", "customer_id", "orders", "customer_id", "left")
    assert scalar(shop, Plan("count", joins=(left,))) == 5
    anti = Plan("count", joins=(left,), filters=(Filter("orders.customer_id", "is_null"),))
    assert scalar(shop, anti) == 2
    assert "LeftAnti" in compile_plan(shop, anti)._jdf.queryExecution().optimizedPlan().toString()
    assert scalar(shop, anti.with_(filters=(Filter("order_id", "is_null"),))) == 2


def test_nulls_in_order(shop):
    up = compile_plan(shop, Plan("lookup", target_columns=("name",), filters=(Filter("balance", "is_not_null"),), sort_column="balance", sort_direction="desc"), "customers")
    assert up.first()["name"] == "Ann"
    groups = Plan("aggregation", aggregation="count", group_by=("customers.status",), sort_column="status")
    assert compile_plan(shop, groups.with_(sort_direction="desc"), "customers").first()[0] is None
    assert compile_plan(shop, groups.with_(sort_direction="asc"), "customers").collect()[-1][0] is None


def test_ties(shop):
    plan = Plan("ranking", target_columns=("name",), sort_column="balance", sort_direction="asc", limit=1, include_ties=True)
    assert sorted(r[0] for r in compile_plan(shop, plan, "customers").collect()) == ["Bo_b", "Dee"]


@pytest.mark.parametrize("pattern, want", [("_", 4), ("o_b", 1), ("%", 4)])
def test_wildcards_count_as_such(shop, pattern, want):
    assert scalar(shop, Plan("count", filters=(Filter("name", "contains", pattern),)), "customers") == want


def test_medians_and_empty_tables(shop):
    assert scalar(shop, Plan("aggregation", aggregation="median", target_columns=("amount",)), "orders") == 6.0
    assert scalar(shop, Plan("row_count"), "archive") == 0
    assert scalar(shop, Plan("percentage", filters=(Filter("note", "equals", "x"),)), "archive") == 0.0
    assert scalar(shop, Plan("percentage", filters=(Filter("status", "equals", "gold"),)), "customers") == 50.0
    assert compile_plan(shop, Plan("aggregation", aggregation="sum", target_columns=("archive_id",)), "archive").first()[0] is None


def test_periods(shop):
    def dates(g):
        return sorted(str(r[0]) for r in compile_plan(shop, Plan("aggregation", aggregation="count", group_by=("placed",), group_by_granularity=g, filters=(Filter("placed", "is_not_null"),)), "orders").collect())

    assert dates("quarter") == ["2023-10-01", "2024-01-01", "2024-04-01"]
    assert dates("week") == ["2023-12-25", "2024-03-25", "2024-04-01", "2024-06-24"]  # Sundays close their week
    assert scalar(shop, Plan("count", filters=(Filter("placed", "year", 2023),)), "orders") == 1


def test_names(shop):
    with pytest.raises(AmbiguousColumn):
        shop.resolve("status", ["orders", "customers"])
    assert str(shop.resolve('[dbo]."ORDERS".Status', ["orders", "customers"])) == "orders.status"
    assert str(shop.resolve("STATUS", ["orders", "customers"], prefer="orders")) == "orders.status"
    with pytest.raises(PlanError):
        compile_plan(shop, Plan("distinct", target_columns=("name",), sort_column="balance"), "customers").collect()
    assert shop.grain("archive") == ("archive_id",)


def test_bad_keys_are_found(spark):
    cat = Catalog.of({"t": spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")}, {"t": ("a",)})
    assert cat.verify_keys() == ["t"] and cat.grain("t") == ("a", "b")


def test_joins_are_checked(shop):
    assert validate(Plan("lookup", joins=(PO,)), shop).ok
    assert not validate(Plan("lookup", joins=(Join("customers", "name", "orders", "status"),)), shop).ok
    assert not validate(Plan("lookup", joins=(PO, PO)), shop).ok
    assert not validate(Plan("lookup", joins=(Join("customers", "customer_id", "orders", "customer_id", "full"),)), shop).ok


@pytest.mark.parametrize(
    "plan",
    [
        Plan("nonsense", table="orders"), Plan("ranking", table="orders"), Plan("lookup", table="orders", limit=0), Plan("lookup", table="orders", sort_column="nothing"),
        Plan("aggregation", table="orders", aggregation="sum"), Plan("aggregation", table="orders", aggregation="sum", target_columns=("status",)),
        Plan("aggregation", table="orders", aggregation="count", having_filters=(Filter("count", "greater_than", 1),)), Plan("derived_aggregation", table="orders", aggregation="average"),
        Plan("lookup", table="orders", filters=(Filter("status", "resembles", 1),)), Plan("unsupported", table="orders"), Plan("aggregation", table="orders", aggregation="count", group_by=("status",), group_by_granularity="month"),
    ],
)
def test_invalid_plans(shop, plan):
    assert not validate(plan, shop).ok


def test_strict_and_extended_minimum(shop):
    plan = Plan("aggregation", table="orders", aggregation="min", target_columns=("placed",))
    assert validate(plan, shop).ok and not validate(plan, shop, strict=True).ok


def test_contract(shop, spark):
    assert to_contract(Plan("row_count"), compile_plan(shop, Plan("row_count"), "orders")) == 5
    assert to_contract(Plan("column_names"), compile_plan(shop, Plan("column_names"), "archive")) == ["archive_id", "note"]
    with pytest.raises(ContractError):
        to_contract(Plan("row_count"), spark.range(3))
    with pytest.raises(ContractError):
        to_contract(Plan("lookup"), spark.range(1).selectExpr("id", "id"))


def test_plans_survive_json():
    plan = Plan("derived_aggregation", aggregation="average", inner_aggregation="sum", distinct=True, joins=(PO,), filters=(Filter("a", "in", [1, 2]),))
    assert Plan.from_json(plan.to_json()) == plan


def test_overlap_and_discovery(shop):
    got = overlap(shop.table("orders").df, "customer_id", shop.table("customers").df, "customer_id").first().asDict()
    assert got == {"left_rows": 5, "right_rows": 4, "left_distinct": 2, "right_distinct": 4, "matching": 2}
    assert judge(Edge("a", "x", "b", "y", 0.8), got).status == "validated"
    assert judge(Edge("a", "x", "b", "y", 0.8), got | {"matching": 0}).status == "rejected"
    assert judge(Edge("a", "x", "b", "y", 0.8), got | {"left_rows": 0}).status == "insufficient_data"
    best = candidates(shop)[0]
    assert {best.left_table, best.right_table} == {"customers", "orders"}
    assert any(e.status == "validated" and {e.left_column, e.right_column} == {"customer_id"} for e in discover(shop))


def test_paths():
    g = Graph([Edge("a", "x", "b", "x", 0.9, "validated"), Edge("b", "y", "c", "y", 0.9, "validated"), Edge("a", "z", "c", "z", 0.5, "validated"), Edge("c", "q", "d", "q", 1.0, "rejected")])
    assert [e.right_table for e in g.best_path("a", "c")] == ["c"]
    assert [e.right_table for e in g.best_path("a", "c", through={"b"})] == ["b", "c"]
    assert g.best_path("a", "d") is None and g.connect(["a", "d"]) is None
    assert len(g.connect(["a", "b", "c"])) == 2


def test_vectors(spark):
    assert [murmur3(x, s) for x, s in ((b"", 0), (b"", 1), (b"test", 0), (b"Hello, world!", 0))] == [0, 0x514E28B7, 0xBA6BD213 - 2**32, 0xC0363E43 - 2**32]
    assert embed("") == [1.0] + [0.0] * 383 and abs(sum(x * x for x in embed("orders by customer")) - 1) < 1e-9
    near = sum(a * b for a, b in zip(embed("customer orders"), embed("order customers")))
    far = sum(a * b for a, b in zip(embed("customer orders"), embed("vessel weight")))
    assert near > 0.4 > far
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<double>")
    assert [r["id"] for r in cosine_top_k(df, "v", [1.0, 0.0], 3, "id").collect()] == [1, 2]


def test_follow_ups(shop):
    earlier = shop.table("customers").df
    got = lambda **p: [r[0] for r in follow_up(earlier, Plan("lookup", target_columns=("customer_id",), **p)).collect()]
    assert got(filters=(Filter("name", "contains", "ANN"),)) == [1]
    assert got(filters=(Filter("status", "not_equals", "gold"),)) == [2, 4]
    assert got(sort_column="balance", sort_direction="desc")[0] == 3
    assert got(filters=(Filter("balance", "greater_than", "60"),)) == [1]
    assert not eligible(Plan("lookup", target_columns=("amount",)), earlier)


@pytest.mark.parametrize(
    "question, want",
    [
        ("How are the tables related?", "relationships"), ("Show foreign keys", "relationships"), ("How many rows are in each table?", "row_statistics"), ("How many records are in the database", "row_statistics"), ("How many rows are there?", "ambiguous_count"),
        ("List all tables", "tables"), ("How many tables are there?", "tables"), ("How many orders are open?", "query"), ("Total amount per customer", "query"),
    ],
)
def test_routes(question, want):
    assert router.route(question) == want


@pytest.mark.parametrize(
    "raw, question, want",
    [
        ({"intent": "aggregation", "aggregation": "avg", "target_columns": "amount"}, "average amount", {"aggregation": "average", "target_columns": ("amount",)}),
        ({"intent": "lookup", "filters": [{"column": "amount", "operator": "between", "value": [1, 5]}]}, "amounts", {"filters": (Filter("amount", "greater_than_or_equal", 1), Filter("amount", "less_than_or_equal", 5))}),
        ({"intent": "lookup", "filters": [{"column": "name", "operator": "like", "value": "A%"}]}, "names", {"filters": (Filter("name", "starts_with", "A"),)}),
        ({"intent": "lookup", "filters": [{"column": "amount", "operator": "=", "value": "null"}]}, "no amount", {"filters": (Filter("amount", "is_null"),)}),
        ({"intent": "lookup", "filters": [{"column": "amount", "operator": "not in", "value": []}]}, "no amount", {"filters": (Filter("amount", "is_null"),)}),
        ({"intent": "count", "group_by": ["placed"]}, "orders per month", {"intent": "aggregation", "aggregation": "count", "group_by_granularity": "month"}),
        ({"intent": "aggregation", "aggregation": "count", "group_by": ["YEAR(placed)"]}, "orders", {"group_by": ("placed",), "group_by_granularity": "year"}),
        ({"intent": "ranking", "sort_column": "amount", "target_columns": ["order_id"]}, "top three orders with ties", {"limit": 3, "include_ties": True, "sort_direction": "desc"}),
        ({"intent": "aggregation", "aggregation": "count", "group_by": ["orders.customer_id"]}, "customers with more than 2 orders", {"having_filters": (Filter("count", "greater_than", 2),)}),
        ({"intent": "aggregation", "aggregation": "count", "group_by": ["orders.customer_id"]}, "which customer has the most orders?", {"limit": 1, "sort_direction": "desc"}),
        ({"intent": "aggregation", "aggregation": "sum", "target_columns": ["amount"], "group_by": ["name"]}, "total amount per name", {"joins": None}),
        ({"intent": "lookup", "target_columns": ["amount"], "joins": [PO.__dict__]}, "amounts", {"joins": ()}),
        ({"intent": "column_names", "table": "orders", "joins": [PO.__dict__]}, "columns of orders", {"joins": (), "table": "orders"}),
        ({"intent": "count", "group_by": ["orders.customer_id"], "filters": [{"column": "orders.status", "operator": "in", "value": ["new", "old"]}]}, "customers with both new and old orders", {"require_all_filter_values": True}),
    ],
)
def test_repair(shop, raw, question, want):
    plan = planner.repair(planner.parse(f"Here: ```{json.dumps(raw)}```"), question, shop, "orders" if "joins" not in raw else None)
    for k, v in want.items():
        if k == "joins" and v is None:
            assert {frozenset((j.left_table, j.right_table)) for j in plan.joins} == {frozenset(("customers", "orders"))}
        else:
            assert getattr(plan, k) == v
    assert validate(plan, shop).ok


class Stub:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def generate_json(self, prompt):
        self.asked.append(prompt)
        return json.dumps(self.answers.pop(0))


def test_ask(shop, tmp_path):
    client = Stub({"intent": "aggregation", "aggregation": "sum", "target_columns": ["amount"], "group_by": ["name"]}, {"intent": "lookup", "target_columns": ["name"], "input_result_reference": "?"})
    engine = Engine(shop, client, PlanCache(tmp_path / "plans.json"), timeout_s=60)
    first = engine.ask("Total amount of orders per customer name?")
    assert {r["name"]: r["aggregation_value"] for r in first.data} == {"Ann": 17.0, "Bo_b": 9.0}
    # Another session, the same question in other words: no second call.
    again = engine.ask("please total amount of orders per customer name", session="other")
    assert again.data == first.data and len(client.asked) == 1
    client.answers[0] |= {"input_result_reference": first.reference, "filters": [{"column": "aggregation_value", "operator": ">", "value": 10}]}
    assert engine.ask("Which of these have over 10?").data == [{"name": "Ann"}]
    assert engine.ask("list all tables").data == ["archive", "customers", "orders"]
    assert {r["table_name"]: r["row_count"] for r in engine.ask("row counts of every table").data} == {"archive": 0, "customers": 4, "orders": 5}
    assert engine.ask("how are the tables related").data == ["customers.customer_id = orders.customer_id"]
    with pytest.raises(PlanError):
        engine.ask(" ")


def test_selection(shop):
    found, sure = select.select("How many orders were placed by customers?", shop)
    assert set(found[:2]) == {"orders", "customers"}
    assert select.select("orders placed in March", shop)[0][0] == "orders"


def test_cache_keys():
    assert canonical("Please show me  Orders?") == canonical("orders")


def test_filters_reach_the_scan(spark):
    from loomquery.sources.tpch import catalog

    cat = catalog(spark, "/root/testdata/sf0.001", ["lineitem", "orders"])
    plan = Plan("aggregation", aggregation="sum", target_columns=("o_totalprice",), joins=(Join("orders", "o_orderkey", "lineitem", "l_orderkey"),), filters=(Filter("l_quantity", "greater_than", 25),))
    text = compile_plan(cat, plan)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
