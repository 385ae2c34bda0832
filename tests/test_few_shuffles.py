"""Steps that every ranking query shares: what crosses the shuffle, and how often."""

from __future__ import annotations

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomrec.operators import cleaning, ranking, recall


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_itemcf_deals_a_users_items_once_and_ranks_them_there(spark):
    rows = [(u, u * k % 7) for u in range(1, 30) for k in range(1, 5)] + [(99, 3), (None, 1), (None, 2)]
    got = recall.itemcf(spark.createDataFrame(rows * 2, "user_id long, item_id long"), 3)
    assert _plan(got).count("Exchange ") == 1
    own: dict = {}
    for u, i in rows:
        if u is not None:
            own.setdefault(u, set()).add(i)
    n, cooc = {}, {}
    for u, items in own.items():
        for i in items:
            n[i] = n.get(i, 0) + 1
        for a, b in permutations(items, 2):
            cooc[a, b] = cooc.get((a, b), 0) + 1
    want = {a: sorted((-round(c / (n[x] * n[b]) ** 0.5, 6), b, c) for (x, b), c in cooc.items() if x == a)[:3] for a, _ in cooc}
    have: dict = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        have.setdefault(r["src"], []).append((-r["score"], r["dst"], r["cooc"]))
        assert (r["src_users"], r["dst_users"]) == (n[r["src"]], n[r["dst"]])
    assert have == want


def test_known_sources_are_counted_without_sets(spark):
    rows = [(1, 2, "b", 0.5, 1), (1, 2, "a", 0.25, 3), (1, 2, "a", 0.25, 3), (1, 3, "c", 1.0, 1), (2, 2, "a", 0.1, 2)]
    long = spark.createDataFrame(rows, "user_id long, item_id long, source string, score double, rank int")
    plain, known = (ranking.coarse_rank(long, {"a": 2.0}, {"b": 0.1}, names=names) for names in (None, ["c", "a", "b"]))
    assert "ObjectHashAggregate" not in _plan(known) and sorted(plain.collect()) == sorted(known.select(*plain.columns).collect())
    with pytest.raises(Exception, match="unknown source"):
        ranking.coarse_rank(long, {}, {}, names=["a", "b"]).collect()


def test_latest_rows_in_one_pass(spark):
    rows = [(u, i, ts, (u * 31 + i * 17 + ts * 7 + k) % 101) for u in range(4) for i in range(3) for ts in (5, 9, 9) for k in range(3)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts long, ord long")
    got = cleaning.latest_exact(df)
    assert _plan(got).count("Exchange ") == 1
    assert sorted(got.collect()) == sorted(cleaning.keep_last(cleaning.exact_dedup(df)).collect()) and got.count() == 12
