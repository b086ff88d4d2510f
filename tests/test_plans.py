"""What the engine's physical plans hold, and what not."""

import re

import numpy as np
import pytest

from loomquery.operators.compile import compile_plan, median
from loomquery.operators.queries import CASES
from loomquery.sources.tpch import catalog

DATA = "/root/testdata/sf0.001"


def plan_of(spark, name):
    plan, table, _, _ = CASES[name]
    df = compile_plan(catalog(spark, DATA, plan.tables() or [table]), plan, table, capped=False)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_fanout_parent_sum", "q_fanout_parent_count", "q_join_semi", "q_join_semi_count"])
def test_a_table_that_only_filters_is_a_semi_join(spark, name):
    text = plan_of(spark, name)
    assert "LeftSemi" in text
    # Nothing is made distinct: the only aggregates are those that make the one result row.
    assert not re.findall(r"HashAggregate\(keys=\[[^\]]", text)


@pytest.mark.parametrize("name", ["q_join_anti_count", "q_join_anti", "q_child_sum_preserved", "q_join_group_count"])
def test_rows_that_joins_cannot_repeat_are_not_made_distinct(spark, name):
    assert "o_orderkey" not in "".join(re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan_of(spark, name)))


def test_only_keys_and_group_values_of_a_child_are_made_distinct(spark):
    for keys in re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan_of(spark, "q_fanout_grouped_sum")):
        assert "totalprice" not in keys and "measure" not in keys


@pytest.mark.parametrize("name", ["q_top_k_ties", "q_ties_without_sort"])
def test_ties_are_no_window_over_one_partition(spark, name):
    text = plan_of(spark, name)
    assert "Window" not in text and "TakeOrderedAndProject" in text


def test_medians_hold_no_group_in_one_task(spark):
    for name in ("q_median", "q_group_median", "q_fanout_parent_median"):
        assert not re.search(r"percentile\(", plan_of(spark, name))


def test_medians_equal_a_plain_one(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 501)] + [("b", float(x)) for x in rng.normal(size=400)] + [("c", 2.5), ("d", None), (None, 1.0), (None, 4.0), ("e", 7.0), ("e", None), ("e", 7.0)]
    got = {r["g"]: r["m"] for r in median(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "m").collect()}
    for g in {k for k, _ in rows}:
        held = [x for k, x in rows if k == g and x is not None]
        assert got[g] == (pytest.approx(float(np.median(held))) if held else None)
    every = [x for _, x in rows if x is not None]
    assert median(spark.createDataFrame(rows, "g string, x double"), [], "x", "m").collect()[0]["m"] == pytest.approx(float(np.median(every)))
    empty = median(spark.createDataFrame([], "g string, x double"), [], "x", "m").collect()
    assert [r["m"] for r in empty] == [None]


@pytest.mark.parametrize("descending", [True, False])
def test_ties_with_nulls(spark, descending):
    from loomquery.operators.compile import _ordered
    from loomquery.plans.ir import Plan
    from pyspark.sql import functions as F

    for values in ([3, 3, 2, 2, 2, 1], [None, 5, None, 5], [None, None], [1], []):
        frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
        for k in (1, 2, 3, 10):
            for first in (False, True):
                if first and not descending:
                    continue
                out = sorted(r["i"] for r in _ordered(frame, F.col("v"), descending, Plan("ranking", limit=k, include_ties=True), nulls_first=first).collect())
                order = lambda v: (v is None) != first if descending else v is None  # noqa: E731, B023
                key = lambda v: (order(v), 0 if v is None else -v if descending else v)  # noqa: E731, B023
                want = sorted(i for i, v in enumerate(values) if sum(key(w) < key(v) for w in values) < k)
                assert out == want, (values, k, first)
