"""Every registered query of the reference's operators against its DuckDB equivalent, and the entry contract."""

from __future__ import annotations

import pytest

import __spark_entry__
from loomrec.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"als_recommendations", "item_word2vec"}))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["category", "item_id", "pop", "recent_pop", "rank"]
