"""Searches between classes of equal rows: equal to plain loops over all rows, without a row for each pair of copies."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomrec.operators import description_scoring as D
from loomrec.operators.classes import best_members, class_heads
from loomrec.operators.semantic import bm25f, hashed_vectors, sparse_cosine

TITLES = ["red ring", "blue ring", "red bolt", "old plate ring", ""]


def shuffled_records(spark, run):
    """What ``run`` returns, and the records that its stages wrote to shuffles."""
    gateway = spark.sparkContext._gateway

    def total():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    out = run()
    return out, sum(n for stage, n in total().items() if stage not in before)


def items(spark, n=2000):
    return spark.createDataFrame([(i, TITLES[i * 7 % 11 % 5], "SMALL" if i % 3 else None) for i in range(n)], "item_id long, title string, category string")


def first(rows, k):
    return [(key, score, n + 1) for n, (score, key) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1]))[:k])]


def test_members_of_tied_classes_are_taken_by_key(spark):
    rows = spark.createDataFrame([(1, "a"), (4, "a"), (2, "b"), (3, "b"), (0, "c"), (9, "d")], "key long, word string")
    heads = class_heads(rows, ["word"], "key", 3)
    assert {(r["word"], r["first"], r["n"], tuple(r["heads"])) for r in heads.collect()} == {("a", 1, 2, (1, 4)), ("b", 2, 2, (2, 3)), ("c", 0, 1, (0,)), ("d", 9, 1, (9,))}
    scored = spark.createDataFrame([("q", 1, 5.0), ("q", 2, 5.0), ("q", 0, 1.0), ("q", 9, 5.0)], "query string, first long, score double")
    assert [r["key"] for r in best_members(scored, heads, ["query"], "key", 3).orderBy("rank").collect()] == [1, 2, 3]


def test_sparse_cosine_of_copies(spark):
    v = hashed_vectors(items(spark), "item_id", "title").cache()
    maps = {}
    for r in v.collect():
        maps.setdefault(r["key"], {})[r["dim"]] = r["w"]
    found, records = shuffled_records(spark, lambda: {tuple(r) for r in sparse_cosine(v, v.filter("key % 50 = 0"), 10).collect()})
    want = set()
    for q in (x for x in maps if x % 50 == 0):
        scores = [(round(sum(w * m.get(d, 0.0) for d, w in maps[q].items()), 6), key) for key, m in maps.items()]
        want |= {(q, *x) for x in first([x for x in scores if x[0] > 0], 10)}
    assert found == want and len(want) > 300
    assert records < 30_000  # pairs of items: 40 queries times 1,600 keys in each task


def test_bm25f_of_copies(spark):
    rows = items(spark).collect()
    texts = {r["item_id"]: ((r["title"] or "").split(), (r["category"] or "").lower().split()) for r in rows}
    queries = spark.createDataFrame([(q, t) for q in range(0, 2000, 50) for t in sorted(set(texts[q][0] + texts[q][1]))], "query long, token string")
    found, records = shuffled_records(spark, lambda: bm25f(items(spark), queries, {"title": 2.0, "category": 1.0}, 10).collect())
    stats = items(spark).select(F.avg(F.size(F.expr("filter(split(lower(title), '[^a-z0-9]+'), t -> length(t) >= 2)"))), F.avg(F.size(F.expr("filter(split(lower(category), '[^a-z0-9]+'), t -> length(t) >= 2)")))).first()
    weight = {}
    for key, fields in texts.items():
        for field, w, avg in zip(fields, (2.0, 1.0), stats):
            for t in set(field):
                weight[key, t] = weight.get((key, t), 0.0) + w * field.count(t) / (0.25 + 0.75 * len(field) / round(avg, 6))
    df = {}
    for _, t in weight:
        df[t] = df.get(t, 0) + 1
    want = set()
    for q in range(0, 2000, 50):
        asked = set(texts[q][0] + texts[q][1])
        scores = [(round(sum(math.log(1 + (2000 - df[t] + 0.5) / (df[t] + 0.5)) * weight[key, t] / (1.2 + weight[key, t]) for t in sorted(asked) if (key, t) in weight), 6), key) for key in texts if any((key, t) in weight for t in asked)]
        want |= {(q, *x) for x in first(scores, 10)}
    assert {tuple(r) for r in found} == want
    assert records < 10_000  # pairs of items: 40 queries times 2,000 items


def test_intents_of_copies(spark):
    """40 like intents over 2,000 records of few texts give each other's rows, and those of one intent over the records alone."""
    records = items(spark)
    fields = [D.Field("title", 5.0, "title"), D.Field("category", 4.0, "category")]
    positions = D.positional_postings(records, "item_id", fields).cache()
    kinds = [("description", None, "red ring"), ("core", 0, "red"), ("intent", 0, "red ring"), ("category", 0, "small"), ("any", None, "ring"), ("negative", 0, "old plate")]
    intents = spark.createDataFrame([(q, *x) for q in range(40) for x in kinds], "query long, kind string, grp int, phrase string")
    found, records = shuffled_records(spark, lambda: D.score_intents(positions, intents, fields, 2000, 10).collect())
    by = {}
    for r in found:
        by.setdefault(r["query"], []).append((r["rank"], r["doc"], r["score"], r["strict_pass"]))
    assert sorted(by) == list(range(40)) and all(sorted(x) == sorted(by[0]) for x in by.values())
    rows = items(spark).collect()
    alike = sorted(r["item_id"] for r in rows if r["title"] == "red ring" and r["category"])
    assert [x[1] for x in sorted(by[0])] == alike[:10] and all(x[3] for x in by[0])
    assert records < 20_000  # pairs of items: 40 queries times 1,500 items
