"""Tables that a query builds once, and hits on unseen items dealt by user."""

from __future__ import annotations

import pytest

from loomrec.operators import candidates as C
from loomrec.operators.tables import once, shared_tables
from loomrec.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["three_stage_ranking", "provided_pool"])
def test_queries_derive_the_interactions_once(spark, sf_dir, name):
    files = QUERIES[name](spark, sf_dir).inputFiles()
    assert files and not [f for f in files if f.endswith(("lineitem.parquet", "orders.parquet"))]


def test_once_is_bound_to_its_scope(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    with shared_tables():
        with shared_tables():
            once(("t",), build)
        assert once(("t",), build).count() == 3 and len(built) == 1
    with shared_tables():
        once(("t",), build)
    assert once(("t",), build).count() == 3 and len(built) == 3


def test_unseen_deals_hits_by_user_alone(spark):
    hits = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 5)], "user_id long, item_id long")
    seen = spark.createDataFrame([(1, 5), (2, 6), (2, 6), (4, 5)], "user_id long, item_id long")
    got = C.unseen(hits, seen)
    assert sorted(tuple(r) for r in got.select("user_id", "item_id").collect()) == [(1, 6), (2, 5), (3, 5)]
    assert got.columns == hits.columns
