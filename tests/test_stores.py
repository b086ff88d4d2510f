import pytest

from loomquery.config import Config, ConfigError
from loomquery.operators import relations
from loomquery.operators.relations import Edge, Graph
from loomquery.operators.vectors import VectorStore, role
from loomquery.plans.cache import JsonCache
from loomquery.sources.catalog import Catalog
from loomquery.sources.tpch import catalog

DATA = "/root/testdata/sf0.001"


def test_vectors_are_stored_and_purged(spark, tmp_path):
    cat = catalog(spark, DATA, ["orders", "customer", "part"])
    store = VectorStore(spark, str(tmp_path))
    store.save("shop", cat)
    found = [r["object"] for r in store.search("shop", cat, "table part key size").collect()]
    assert found[0].startswith("part")
    assert store.purge("shop") and not store.purge("shop")


@pytest.mark.parametrize("table, column, want", [("orders", "o_orderkey", "identifier"), ("orders", "o_orderdate", "temporal"), ("orders", "o_totalprice", "numeric"), ("orders", "o_orderstatus", "category"), ("part", "p_name", "name"), ("lineitem", "l_partkey", "identifier")])
def test_roles(spark, table, column, want):
    assert role(catalog(spark, DATA, [table]), table, column) == want


def test_verdicts_are_kept(spark, tmp_path, monkeypatch):
    cat = catalog(spark, DATA, ["documents", "labels"])
    cat.foreign_keys = ()
    cache = JsonCache(tmp_path / "edges.json")
    first = relations.discover(cat, cache)
    assert [(e.left_column, e.right_column, e.status) for e in first] == [("doc_id", "doc_id", "validated")]
    monkeypatch.setattr(relations, "overlaps", None)
    again = Catalog(cat.items)
    assert relations.discover(again, cache) == first and again.validated


def test_ambiguity_and_bridges():
    g = Graph([Edge("a", "x", "b", "x", 0.9, "validated"), Edge("b", "y", "c", "y", 0.9, "validated"), Edge("a", "z", "d", "z", 0.5, "validated"), Edge("d", "q", "c", "q", 1.0, "validated")])
    assert g.ambiguous("a", "c") and g.bridges("a", "c") == ["b", "d"] and not g.ambiguous("a", "b")


def test_settings():
    assert Config.read({}) == Config()
    assert Config.read({"LOOM_TIMEOUT_S": "0", "LOOM_STRICT": "yes", "LOOM_DATA": "/x"}) == Config("/x", None, 0.0, None, True)
    for bad in ({"LOOM_TIMEOUT_S": "-1"}, {"LOOM_TIMEOUT_S": "soon"}, {"LOOM_STRICT": "perhaps"}, {"LOOM_DATA": "a", "LOOM_JDBC_URL": "b"}):
        with pytest.raises(ConfigError):
            Config.read(bad)


def test_a_session_is_kept_and_restored(spark, tmp_path):
    from loomquery.operators.compile import compile_plan
    from loomquery.plans.ir import Filter, Plan
    from loomquery.sources.session import TURNS, Sessions

    cat = catalog(spark, DATA, ["customer"])
    plan = Plan("lookup", table="customer", target_columns=("c_custkey", "c_name"), filters=(Filter("c_custkey", "less_than", 8),), sort_column="c_custkey")
    held = Sessions(str(tmp_path / "talk"))
    first = held.save("me", "which customers?", plan, compile_plan(cat, plan))
    kept = held.stored(spark, "me").collect()
    assert [r["reference"] for r in kept] == [first] and len(kept[0]["rows"]) == 8
    again = Sessions(str(tmp_path / "talk"))
    turns = again.restore(spark, "me", lambda p: compile_plan(cat, p))
    assert turns[0].plan == plan and turns[0].result.count() == 8 and again.find("me", first)
    for _ in range(TURNS):
        held.save("me", "again?", plan, compile_plan(cat, plan))
    assert not spark.catalog.tableExists(first)
    held.close(spark, "me")
    assert held.context("me") == []


def test_what_a_session_keeps_is_the_first_in_order(spark):
    from loomquery.operators.followup import bounded

    frame = spark.createDataFrame([(x % 1500, -x) for x in range(4000)], "a int, b int").repartition(7).orderBy("b")
    assert [r["b"] for r in bounded(frame).collect()] == list(range(-3999, -3899))
    got = [r["a"] for r in bounded(frame.select("a")).collect()]
    assert got == list(dict.fromkeys(x % 1500 for x in range(3999, -1, -1)))[:1000]


def test_overlaps_of_many_candidates_are_those_of_each(spark):
    cat = catalog(spark, DATA, ["documents", "labels", "customer", "orders", "nation"])
    edges = [Edge("documents", "doc_id", "labels", "doc_id", 1.0), Edge("orders", "o_custkey", "customer", "c_custkey", 1.0), Edge("customer", "c_nationkey", "nation", "n_nationkey", 1.0), Edge("nation", "n_name", "customer", "c_name", 1.0)]
    for e, counts in zip(edges, relations.overlaps(cat, edges)):
        want = relations.overlap(cat.table(e.left_table).df, e.left_column, cat.table(e.right_table).df, e.right_column).first().asDict()
        assert {k: counts[k] for k in want} == want


def test_plans_join_along_discovered_edges(spark):
    from loomquery.plans.ir import Plan
    from loomquery.plans.planner import connected
    from loomquery.service import Engine

    cat = catalog(spark, DATA, ["documents", "labels"])
    cat.foreign_keys = ()
    engine = Engine(cat)
    plan = Plan("aggregation", aggregation="count", target_columns=("documents.doc_id",), group_by=("labels.quality",))
    with pytest.raises(Exception, match="no relationship"):
        connected(plan, cat)
    engine.learn_relationships()
    answer = engine.run(connected(plan, cat))
    assert sum(r["aggregation_value"] for r in answer.data) == cat.table("labels").df.count()


def test_false_keys_are_found_once(spark):
    from loomquery.plans.ir import Join, Plan
    from loomquery.service import Engine
    from loomquery.sources.catalog import ForeignKey

    one = spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "k int, m int")
    two = spark.createDataFrame([(1,), (2,)], "k int")
    engine = Engine(Catalog.of({"one": one, "two": two}, {"one": ("k",), "two": ("k",)}, (ForeignKey("two", ("k",), "one", ("k",)),)))
    plan = Plan("aggregation", aggregation="count", target_columns=("two.k",), joins=(Join("two", "k", "one", "k"),))
    answer = engine.run(plan)
    assert answer.warnings and "one" in answer.warnings[-1] and answer.data == [{"aggregation_value": 2}]
    assert engine.verify() == []


def test_probe_and_settings(spark, tmp_path):
    from loomquery.errors import PlanError
    from loomquery.service import Engine

    cat = catalog(spark, DATA, ["nation"])
    assert cat.probe(spark) == {"catalog": "spark_catalog", "database": "default", "tables": 1}
    with pytest.raises(PlanError, match="not to"):
        cat.probe(spark, "other")
    engine = Engine.of(spark, Config("/root/testdata/sf0.001", None, 5.0, str(tmp_path), True), ["nation", "region"])
    assert engine.strict and engine.timeout_s == 5.0 and engine.sessions.path and engine.cache is not None
    with pytest.raises(PlanError):
        Engine.of(spark, Config(), ["nation"])


def test_large_results_stay_frames(spark):
    from loomquery.errors import ContractError
    from loomquery.plans.ir import Plan
    from loomquery.plans.validate import to_contract

    with pytest.raises(ContractError, match="more than 10 rows"):
        to_contract(Plan("lookup"), spark.range(11).toDF("a"), most=10)


@pytest.mark.parametrize("word, op", [("over", "greater_than"), ("fewer than", "less_than"), ("among", "in"), ("no less than", "greater_than_or_equal"), ("no more than", "less_than_or_equal"), ("contain", "contains"), ("greater than or equal to", "greater_than_or_equal"), ("up to", "less_than_or_equal"), ("none of", "not_in"), ("starting with", "starts_with")])
def test_spellings_of_operators(word, op):
    from loomquery.plans.ir import OPERATORS, Filter
    from loomquery.plans.planner import normal_filter

    found = normal_filter(Filter("a", word, ["x"] if op in ("in", "not_in") else "x"))
    assert [f.operator for f in found] == [op] and op in OPERATORS


def test_a_bare_column_of_several_tables_is_an_error(spark):
    from loomquery.errors import AmbiguousColumn
    from loomquery.plans.ir import Plan
    from loomquery.plans.planner import named_tables

    frame = lambda *c: spark.createDataFrame([], ", ".join(f"{x} int" for x in c))
    cat = Catalog.of({"a": frame("id", "status", "only"), "b": frame("id", "status"), "c": frame("other")})
    with pytest.raises(AmbiguousColumn):
        named_tables(Plan("lookup", target_columns=("status",)), cat)
    assert named_tables(Plan("lookup", target_columns=("status", "only")), cat) == ["a"]
    assert named_tables(Plan("lookup", table="b", target_columns=("status",)), cat) == ["b"]
    assert named_tables(Plan("lookup", target_columns=("b.status", "other")), cat) == ["b", "c"]


def test_the_rows_behind_an_aggregate(spark):
    from loomquery.operators.compile import compile_plan
    from loomquery.operators.followup import details
    from loomquery.plans.ir import Filter, Join, Plan

    cat = catalog(spark, DATA, ["orders", "customer"])
    edge = Join("orders", "o_custkey", "customer", "c_custkey")
    total = Plan("aggregation", aggregation="sum", target_columns=("o_totalprice",), joins=(edge,), filters=(Filter("c_mktsegment", "equals", "BUILDING"),))
    rows = details(total, Plan("lookup", target_columns=("o_orderkey", "o_totalprice"), filters=(Filter("o_totalprice", "greater_than", 1000),)))
    assert rows.distinct and rows.joins == (edge,) and rows.aggregation is None and len(rows.filters) == 2
    got = compile_plan(cat, rows, capped=False)
    want = compile_plan(cat, total).first()[0]
    small = cat.table("orders").df.join(cat.table("customer").df, cat.table("orders").df["o_custkey"] == cat.table("customer").df["c_custkey"]).where("c_mktsegment = 'BUILDING' and o_totalprice <= 1000").agg({"o_totalprice": "sum"}).first()[0] or 0
    assert got.agg({"o_totalprice": "sum"}).first()[0] + small == pytest.approx(want)


def test_messages_hold_no_secrets():
    from loomquery.errors import masked

    assert masked("no route to jdbc:postgresql://me:hush@host/db?user=me&password=hush now") == "no route to jdbc:postgresql://***@host/db?user=***&password=*** now"
