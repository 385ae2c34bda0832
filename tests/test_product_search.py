"""Exact search by inner products of blocks, and the ALS recommendations over it."""

from __future__ import annotations

import numpy as np

from loomrec.operators.recall import als_factors
from loomrec.operators.vector_join import product_top_k


def test_product_search_equals_all_products(spark):
    rng = np.random.default_rng(7)
    q = np.round(rng.normal(size=(40, 3)) * 4) / 4
    v = np.round(rng.normal(size=(90, 3)) * rng.exponential(size=(90, 1)) * 4) / 4  # quarters: products are exact, many are equal
    q[0] = 0
    table = lambda m: spark.createDataFrame([(i * 3, [float(x) for x in row]) for i, row in enumerate(m)], "id long, vector array<float>")
    want = {i * 3: [(int(j) * 3, float(s[j])) for j in np.lexsort((np.arange(len(v)), -s))[:5]] for i, s in enumerate(q @ v.T)}
    for query_rows, item_rows, tile in ((7, 11, 4), (1000, 1000, 8), (1000, 3, 1000)):
        got: dict = {}
        for r in sorted(product_top_k(table(q), table(v), 5, query_rows, item_rows, tile).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query"], []).append((r["item"], r["score"]))
        assert got == want
    assert product_top_k(table(q), table(v).limit(0), 5).count() == product_top_k(table(q).limit(0), table(v), 5).count() == 0
    assert product_top_k(table(q), table(v).limit(2), 5).count() == 80


def test_als_meets_all_items_without_a_cross_join(spark):
    rows = [(u, i, 1 + (u * i) % 5) for u in range(30) for i in range(40) if (u * 7 + i * 3) % 5 < 2]
    got = als_factors(spark.createDataFrame(rows, "user_id long, item_id long, rating long"), k=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    found = got.collect()
    assert [f.simpleString() for f in got.schema] == ["user_id:int", "item_id:int", "rank:int"]
    assert len(found) == 120 and len({(r["user_id"], r["item_id"]) for r in found}) == 120
