"""Exact nearest neighbours by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdmill.operators import vectors


def brute(queries, rows, k, not_self):
    unit = lambda v: np.array(v) / np.linalg.norm(v) if np.linalg.norm(v) > 0 else np.zeros(len(v))
    out = {}
    for q, v in queries:
        scored = [(-round(float(np.clip(unit(v) @ unit(x), -1, 1)), 6) + 0.0, key) for key, x in rows if not (not_self and key == q)]
        out[q] = [(key, -s + 0.0) for s, key in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r["rank"])):
        out.setdefault(r[0], []).append((r[1], r["score"]))
    return out


def data(kind, n, d, rnd):
    if kind == "uniform":
        x = rnd.normal(size=(n, d))
    elif kind == "crowds":
        x = rnd.normal(size=(12, d))[rnd.integers(0, 12, n)] + 0.1 * rnd.normal(size=(n, d))
    else:  # one crowd of equal rows that holds a third, zero vectors, opposite ones
        x = rnd.normal(size=(n, d))
        x[::3], x[1::50], x[2] = x[0], 0.0, -x[0]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind, n, k", [("uniform", 700, 10), ("crowds", 2500, 5), ("ties", 900, 7), ("ties", 4, 10)])
def test_nearest_is_exact(spark, monkeypatch, kind, n, k):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 16)
    rows = data(kind, n, 12, np.random.default_rng(n))
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = rows[:: max(n // 40, 1)]
    got = found(vectors.nearest(corpus.where(F.col("vec_id").isin(*(i for i, _ in asked))), corpus, k))
    assert got == brute(asked, rows, k, True)


def test_blocks_that_the_bound_rules_out_are_not_read(spark, monkeypatch):
    """Where rows stand in crowds, a search reads few blocks, and no plan crosses tables."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rows = data("crowds", 3000, 16, np.random.default_rng(1))
    corpus = spark.createDataFrame(rows, "key long, vector array<double>")
    cells = vectors.build_cells(corpus, 16)
    scored, real = [], vectors._score
    monkeypatch.setattr(vectors, "_score", lambda pairs, *a: scored.append(pairs.count()) or real(pairs, *a))
    result = vectors.search_cells(corpus.where("key < 50").toDF("query_id", "vector"), cells, 5, 16)
    assert found(result) == brute(rows[:50], rows, 5, False)
    assert scored[1] < 0.25 * 50 * cells.blocks.count()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_null_short_and_missing_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.6, 0.8])], "vec_id long, embedding array<double>")
    got = found(vectors.nearest(rows, rows, 3))
    assert got[1] == [(4, 0.6), (2, 0.0), (3, 0.0)] and got[2] == [(1, 0.0), (3, 0.0), (4, 0.0)]
    assert vectors.nearest(rows, rows.limit(0), 3).count() == 0 and vectors.nearest(rows.limit(0), rows, 3).count() == 0
