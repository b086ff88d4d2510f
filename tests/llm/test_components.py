"""Connected components against union-find, and the rows that their joins make."""

import re

import numpy as np
import pytest

from loomquery.llm import simhash


def joined(spark, since):
    """Rows that joins have made in executions after this one, and the last execution."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    ids = [runs.apply(i).executionId() for i in range(runs.size())]
    for one in (i for i in ids if i > since):
        values, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for x in (node.metrics().apply(i) for i in range(node.metrics().size())) if re.search("Join", node.name()) else ():
                if x.name() == "number of output rows" and values.contains(x.accumulatorId()):
                    made += int(values.apply(x.accumulatorId()).replace(",", ""))
    return made, max(ids, default=-1)


def least(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def graphs():
    rng = np.random.default_rng(41)
    names = rng.integers(-(2**63), 2**63 - 1, 3000).tolist()
    yield "path of rising nodes", [(i, i + 1) for i in range(400)]
    yield "star round the largest", [(9999, i) for i in range(500)]
    yield "random", [(names[i], names[j]) for i, j in rng.integers(0, 3000, (2000, 2)).tolist() if i != j]
    yield "twos and repeats", [(2 * i, 2 * i + 1) for i in range(50)] * 2 + [(2 * i + 1, 2 * i) for i in range(50)]


@pytest.mark.parametrize("few", [0, 30, 20_000])
@pytest.mark.parametrize("edges", [g for _, g in graphs()], ids=[n for n, _ in graphs()])
def test_components_equal_union_find(spark, edges, few):
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()
    assert len(got) == len(least(edges)) and {r["node"]: r["label"] for r in got} == least(edges)


def test_no_edges_no_components(spark):
    none = spark.createDataFrame([(3, 3)], "a long, b long")
    assert simhash.components(none).collect() == [] and simhash.components(none, few=0).collect() == []


def test_a_group_linked_many_times_over_is_not_joined_in_every_round(spark):
    """As bands of 40 tables leave it: each spans the group from other items."""
    rng = np.random.default_rng(42)
    items = np.sort(rng.integers(-(2**62), 2**62, 1500))
    edges = {(int(items[rng.integers(0, max(1, i // 10))]), int(items[i])) for _ in range(40) for i in rng.integers(1, 1500, 1000)}
    frame = spark.createDataFrame(sorted(edges), "a long, b long")
    _, since = joined(spark, -1)
    labels = dict(map(tuple, simhash.components(frame).collect()))
    made, _ = joined(spark, since)
    assert len(edges) > simhash.FEW and labels == least(edges)
    assert made < 2.5 * len(edges)
