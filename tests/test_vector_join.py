"""Exact vector joins against NumPy: ties, copies, unusable vectors, seen pairs, empty sides, any block size."""

from __future__ import annotations

import numpy as np
import pytest

from loomrec.operators import vector_join as N

SCHEMA = "id long, vector array<double>"


def brute(queries, items, k, seen=(), drop_self=False):
    out = set()
    for q, x in queries:
        near = []
        for i, y in items:
            s = round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
            if s > 0 and (q, i) not in seen and not (drop_self and q == i):
                near.append((-s, i))
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(near)[:k], 1)}
    return out


@pytest.mark.parametrize("rows", [3, 10, 1000])
def test_equals_brute_force(spark, rows):
    rng = np.random.default_rng(rows)
    items = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(40)]
    items = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in items] + [(100 + i, [1.0, 1.0, 0.0]) for i in range(12)]  # ties and copies
    queries = [(i, v) for i, v in items if i % 3 == 0] + [(-5, [0.5, 0.5, 0.25])]
    seen = {(0, 1), (-5, 100), (-5, 101), (3, 9), (777, 1)}
    q, v = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(items, SCHEMA)
    s = spark.createDataFrame([*seen, (None, 1), (0, None), (0, 1)], "query long, item long")
    got = {tuple(r) for r in N.block_top_k(q, v, 4, seen=s, drop_self=True, rows=rows).select("query", "item", "score", "rank").collect()}
    assert got == brute(queries, items, 4, seen, True)
    assert {tuple(r) for r in N.block_top_k(q, v, 200, rows=rows).select("query", "item", "score", "rank").collect()} == brute(queries, items, 200)


def test_unusable_vectors_and_empty_sides(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "x"), (2, [nan, 0.0], "x"), (3, [inf, 0.0], "x"), (4, [0.0, 0.0], "x"), (5, [1.0], "x"), (6, None, "x"), (None, [1.0, 1.0], "x"), (7, [1.0, None], "x"), (8, [1e300, 1e300], "x")]
    v = N.usable(spark.createDataFrame(rows, "item_id long, vector array<double>, rank string"), "item_id", "vector", 2)
    assert {r["id"] for r in v.collect()} == {1, 8}
    none = v.filter("id < 0")
    assert N.block_top_k(v, none, 3).count() == N.block_top_k(none, v, 3).count() == N.block_top_k(none, none, 3).count() == 0
    assert [(r["query"], r["item"], r["score"]) for r in N.block_top_k(v, v, 3, drop_self=True).orderBy("query").collect()] == [(1, 8, 0.707107), (8, 1, 0.707107)]


def test_any_number_of_queries(spark):
    rng = np.random.default_rng(8)
    items = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)]
    df = spark.createDataFrame([*items, (70, [1.0]), (71, None)], SCHEMA)
    good = [(i, v) for i, v in items if any(v)]
    got = {tuple(r) for r in N.vector_top_k(df, df, "id", "vector", 5, rows=16).select("query", "item", "score", "rank").collect()}
    assert got == brute(good, good, 5, drop_self=True)
    assert N.vector_top_k(df.limit(0), df, "id", "vector", 5).count() == N.vector_top_k(df, df.limit(0), "id", "vector", 5).count() == 0


def test_dense_recall_and_reasons(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)], "item_id long, vector array<double>")
    seeds = spark.createDataFrame([(10, 1, 1), (10, 2, 2), (11, 4, 1), (12, 9, 1), (13, 1, 1), (13, 3, 2)], "user_id long, item_id long, seed_rank int")
    seen = spark.createDataFrame([(10, 1), (13, 1), (13, 3), (13, 2)], "user_id long, item_id long")
    got = N.dense_recall(seeds, vectors, seen, 2, 2)
    assert {(r["user_id"], r["item_id"], r["rank"]) for r in got.collect()} == {(10, 3, 1), (10, 2, 2)}
    cover = {tuple(r) for r in N.dense_coverage(got, seeds, vectors, 2, 2).collect()}
    assert cover == {(10, 2, 2, 2, None), (11, 1, 0, 0, "no_seed_vector"), (12, 1, 0, 0, "no_seed_vector"), (13, 2, 2, 0, "nothing_found")}
    tower = N.Tower(np.array([[1.0, -1.0]]), np.array([-0.1]), np.array([[0.0], [2.0]]), np.array([0.5, 0.0]))
    x = np.array([0.8, 0.6])
    assert tower(x) == pytest.approx([1.3, 0.6 + 2 * 0.1])
    user = {r["id"]: r["vector"] for r in N.user_vectors(seeds.filter("user_id = 10"), N.usable(vectors, "item_id", "vector", 2), 2, tower).collect()}
    mean = np.array([1.0, 0.8]) / np.sqrt(1.64)
    assert user[10] == pytest.approx(tower(mean), abs=1e-5)
