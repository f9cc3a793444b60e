"""Leaders in order against the sequential rule."""

import random

import pytest

from mdmill.operators import cluster


def sequential(items, edges):
    before = {}
    for a, b in edges:
        before.setdefault(a, set()).add(b)
    leads = set()
    for i in sorted(items):
        if not before.get(i, set()) & leads:
            leads.add(i)
    return leads


def found(spark, items, edges, **how):
    state, rounds = cluster.leaders_in_order(spark.createDataFrame([(i,) for i in items], "id long"), spark.createDataFrame(edges, "id long, before long").repartition(3), **how)
    rows = state.collect()
    assert len(rows) == len(items)
    return {r["id"] for r in rows if r["state"] == "leads"}, rounds


def test_a_path_takes_one_round(spark):
    n = 10_000
    leads, rounds = found(spark, range(n), [(i, i - 1) for i in range(1, n)])
    assert leads == set(range(0, n, 2)) and rounds <= 2


def test_a_path_cut_into_parts_takes_few_rounds(spark):
    n = 1000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(max(a, b), min(a, b)) for a, b in zip(order, order[1:])]
    leads, rounds = found(spark, range(n), edges, task_edges=300)
    assert leads == sequential(range(n), edges) and rounds <= 6


@pytest.mark.parametrize("seed, n, m, task_edges", [(2, 200, 500, 60), (4, 30, 200, 20), (5, 5, 0, 10)])
def test_random_graphs(spark, seed, n, m, task_edges):
    rnd = random.Random(seed)
    edges = sorted({(max(p), min(p)) for p in (rnd.sample(range(n), 2) for _ in range(m))})
    if seed == 4:
        edges = sorted({*edges, *((i, 0) for i in range(1, n))})  # all match the first
    leads, _ = found(spark, range(n), edges, task_edges=task_edges)
    assert leads == sequential(range(n), edges)
