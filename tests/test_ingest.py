"""Ingest, semantic and workflow operators on literal fixtures: blanks, nulls, ties, boundaries, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomrec.operators import ingest, semantic, workflow


def test_conflicts_fill_blanks_in_order(spark):
    rows = [(1, 2, "late", ["b"]), (1, 1, " ", ["a"]), (1, 3, "later", None), (2, 1, None, ["c"])]
    df = spark.createDataFrame(rows, "id long, ord long, title string, src array<string>")
    got = {r["id"]: (r["title"], r["src"], r["n_rows"]) for r in ingest.merge_conflicts(df, "id", "ord", ["title"], ["src"]).collect()}
    assert got == {1: ("late", ["a", "b"], 3), 2: (None, ["c"], 1)}
    assert ingest.merge_conflicts(df.limit(0), "id", "ord", ["title"], ["src"]).count() == 0


def test_import_plan_refuses_unknown_and_infinite(spark):
    rows = [(1, 10, "a", 0.5), (1, 11, "a", 0.9), (1, 12, "a", float("nan")), (1, 13, "a", float("inf")), (1, 14, "z", 1.0), (1, 15, "a", None)]
    got = {r["item_id"]: (r["rank"], r["accepted"]) for r in ingest.import_plan(spark.createDataFrame(rows, "user_id long, item_id long, source string, score double"), {"a"}).collect()}
    assert got == {10: (2, 1), 11: (1, 1), 12: (None, 0), 13: (None, 0), 14: (None, 0), 15: (None, 0)}


def test_leakage_is_rejected(spark):
    with pytest.raises(ValueError):
        ingest.reject_fields(spark.range(1).withColumn("Label", F.lit(1)), ["label"])
    assert ingest.forbidden_scopes({"a": [{"test": 1}, "Valid"], "b": 2}, {"test", "valid"}) == ["$.a[0].test", "$.a[1]"]


def test_family_sample_skips_similar_titles(spark):
    items = spark.createDataFrame([(1, "red small box", "c"), (2, "red small box", "c"), (3, "blue large lamp", "c"), (4, None, "d")], "item_id long, title string, category string")
    got = ingest.family_sample(items, 5, 10).collect()
    assert len([r for r in got if r["category"] == "c"]) == 2 and len({r["item_id"] for r in got} & {1, 2}) == 1


def test_validated_counts(spark):
    assert ingest.validated({"a": spark.range(3)}, {"a": 3}) == []
    assert ingest.validated({"a": spark.range(3)}, {"a": 2, "b": 1}) == ["b: missing", "a: 3 rows, 2 stated"]


def test_walks_follow_edges(spark):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (2, 1, 0.5), (3, 4, 2.0)]
    known = {(a, b) for a, b, _ in edges}
    walks = semantic.weighted_walks(spark.createDataFrame(edges, "src long, dst long, score double"), 3, 2).collect()
    assert len(walks) == 6 and all((a, b) in known for r in walks for a, b in zip(r["path"], r["path"][1:]))
    assert all(len(r["path"]) == 4 or r["path"][-1] == 4 for r in walks)


def test_context_is_truncated_where_it_crosses(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 60), (1, 3, 60)], "query long, rank int, length int")
    assert [(r["rank"], r["used"]) for r in semantic.context_limit(df, 100).orderBy("rank").collect()] == [(1, 60), (2, 40)]


def test_older_and_equal_versions_change_nothing(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, version long, v string")
    got = workflow.apply_newer(make([(1, 5, "s"), (2, 5, "s"), (3, 5, "s")]), make([(1, 5, "u"), (2, 4, "u"), (3, 6, "u"), (4, 1, "u")]), ["id"], "version")
    assert {r["id"]: r["v"] for r in got.collect()} == {1: "s", 2: "s", 3: "u", 4: "u"}


def test_backoff_and_transition(spark):
    df = spark.createDataFrame([(0,), (3,), (8,), (9,), (60,)], "n long")
    assert [r["w"] for r in df.select(workflow.backoff_seconds(F.col("n")).alias("w")).collect()] == [1, 8, 256, 300, 300]
    rows = spark.createDataFrame([("WAIT", "PAID"), ("DONE", "PAID"), ("WAIT", None), (None, "PAID")], "s string, w string")
    assert [r["state_after"] for r in workflow.guarded_transition(rows, "s", F.col("w"), "WAIT").collect()] == ["PAID", "DONE", "WAIT", None]
