"""Groups streamed in order: groups across batches, null keys, and the rules over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrec.operators import events as V
from loomrec.operators import ranking as R
from loomrec.operators.streamed import in_order


def test_groups_cross_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).unionByName(spark.sql("select cast(null as long) k, 500L v"))
        got = in_order(df, "k", [F.col("v").desc()], lambda rows: [(rows[0][0], [r[1] for r in rows])], "k long, vs array<long>")
        want = {k: [v for v in range(99, -1, -1) if v % 7 == k] for k in range(7)} | {None: [500]}
        assert {r["k"]: r["vs"] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_small_groups_make_no_frames(spark):
    ranked = spark.createDataFrame([(1, i, i, 1.0 / i) for i in range(1, 6)], "user_id long, item_id long, final_rank int, final double")
    items = spark.createDataFrame([(i, "a b", "c" if i < 4 else "d", "x") for i in range(1, 6)], "item_id long, title string, category string, brand string")
    log = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (1, 5, 3), (1, None, 4), (2, 11, 1)], "item_id long, qty long, ord long")
    screen, feed, stock = R.first_screen(ranked, items, 3, 2, 2), R.marginal_relevance(ranked, items, 3), V.guarded_stock(log, 10)
    for df in (screen, feed, stock):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["item_id"] for r in screen.orderBy("place").collect()] == [1, 2, 3, 4, 5]
    assert feed.count() == 3 and feed.orderBy("place").first()["item_id"] == 1
    assert sorted(tuple(r) for r in stock.collect()) == [(1, 0, 2, 2), (2, 10, 0, 1)]
