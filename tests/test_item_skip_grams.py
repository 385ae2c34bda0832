"""Item vectors: the query returns them whole, for items of one kind of sequence closer than for others."""

from __future__ import annotations

import math

from loomrec.operators import recall
from loomrec.plans.queries import QUERIES


def test_query_returns_the_vectors(spark, sf_dir):
    rows = QUERIES["item_word2vec"](spark, sf_dir).collect()
    assert rows and all(r["dim"] == len(r["vector"]) == 16 and all(math.isfinite(x) for x in r["vector"]) for r in rows)
    assert len({tuple(r["vector"]) for r in rows}) > 1


def test_many_items_are_fitted_without_the_driver(spark, monkeypatch):
    import pyspark.ml.feature as ml

    monkeypatch.setattr(ml.Word2Vec, "fit", None)
    rows = [(u, 10 * (u % 2) + (u * 7 + p * p) % 5, p) for u in range(1000) for p in range(1, 11)] + [(999, 77, 1)]
    events = spark.createDataFrame(rows, "user_id long, item_id long, pos int")
    got, again = ({r["item_id"]: r["vector"] for r in recall.item_skip_grams(events, 16, 5000, 3).collect()} for _ in range(2))
    assert got == again and got.keys() == {r[1] for r in rows} and {len(v) for v in got.values()} == {16}

    def cosine(a, b):
        return sum(x * y for x, y in zip(got[a], got[b])) / math.hypot(*got[a]) / math.hypot(*got[b])

    within = [cosine(a, b) for a in got for b in got if a < b < 77 and a // 10 == b // 10]
    between = [cosine(a, b) for a in got for b in got if a < 10 <= b < 77]
    assert sum(within) / len(within) > sum(between) / len(between) + 0.5
