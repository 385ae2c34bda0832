"""Seeded recall, pools of providers, records, batches and the perceptron on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrec.operators import records, rerank, seeded


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, pos int, len int, strong int")


def test_strong_seeds_come_first_and_once(spark):
    e = events(spark, [(1, 10, 1, 4, 1), (1, 11, 2, 4, 0), (1, 12, 3, 4, 1), (1, 10, 4, 4, 0)])
    got = sorted((r.seed_rank, r.item_id) for r in seeded.strong_first_seeds(e, 10, 2).collect())
    assert got == [(0, 12), (1, 10)]
    assert seeded.strong_first_seeds(e.limit(0)).count() == 0


def test_seeded_recall_takes_the_best_seed_and_skips_seen(spark):
    seeds = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "user_id long, item_id long, seed_rank int")
    edges = spark.createDataFrame([(10, 20, 0.4, 1), (11, 20, 0.8, 1), (11, 21, 0.1, 2), (10, 22, 0.9, 2)], "src long, dst long, score double, rank int")
    seen = spark.createDataFrame([(1, 22), (1, 22)], "user_id long, item_id long")
    got = [(r.item_id, r.score, r.seed_item, r.rank) for r in seeded.seeded_recall(seeds, edges, seen, decay=0.5, floor=0.06).collect()]
    assert got == [(20, 0.4, 10, 1)]  # 0.8 * 0.5 ties with 0.4: the earlier seed; 21 is below the floor


def test_fallbacks_serve_only_users_short_of_the_target(spark):
    t = "user_id long, item_id long, score double"
    first = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (2, 1, 1.0)], t)
    second = spark.createDataFrame([(1, 9, 9.0), (2, 8, 0.5), (3, 7, 0.1)], t)
    third = spark.createDataFrame([(2, 6, 0.2), (3, 6, 0.2), (3, 7, 5.0)], t)
    seen = spark.createDataFrame([(9, 9)], "user_id long, item_id long")
    rows = seeded.provided_pool({"a": first}, {"b": second, "c": third}, seen, 2).collect()
    assert sorted((r.user_id, r.item_id, r.sources, r.fallback_used, r.underfilled) for r in rows) == [
        (1, 1, "a", 0, 0), (1, 2, "a", 0, 0), (2, 1, "a", 1, 0), (2, 8, "b", 1, 0), (3, 6, "c", 1, 0), (3, 7, "b,c", 1, 0)]


def test_a_broken_provider_leaves_the_others(spark):
    plans, degraded = seeded.available({"good": lambda: spark.range(1), "bad": lambda: spark.read.parquet("/nowhere/at/all")})
    assert list(plans) == ["good"] and list(degraded) == ["bad"]


def test_noisy_items_are_seeds_but_no_neighbours(spark):
    e = events(spark, [(u, i, 1, 1, 0) for u in (1, 2, 3) for i in ((5, 6) if u < 3 else (5,))])
    got = sorted((r.src, r.dst, r.score) for r in seeded.co_visit_sets(e, 2, 2.0).collect())
    assert got == [(5, 6, 2.0)]


def test_records_fall_back_and_clip(spark):
    df = spark.createDataFrame([(1, " ", "Lamp ", ["Home > x", "Light"], "Acme"), (2, None, None, None, None)], "item_id long, title_clean string, title string, categories_path array<string>, brand string")
    r = records.normalise_records(df).select("item_id", "category", "title", records.compact_text(["title", "main_category", "store"]).alias("c"), records.profile_text(12).alias("p")).orderBy("item_id").collect()
    assert (r[0].category, r[0].title, r[0].c, r[0].p) == ("Home", "Lamp", "Lamp | Home | Acme", "Title: Lamp\nCat"[:12].rstrip())
    assert (r[1].category, r[1].c, r[1].p) == (None, "", "")


def test_one_bad_command_rolls_its_batch_back(spark):
    c = spark.createDataFrame([(1, 1), (1, None), (2, 3)], "batch int, v int")
    assert [r.v for r in records.append_batches(c, F.col("v") > 0).collect()] == [3]


def test_perceptron_orders_separable_pairs(spark):
    rows = spark.createDataFrame([(u, i, int(i == 0), float(i == 0), 1.0) for u in range(4) for i in range(5)], "user_id int, item_id int, label int, good double, same double")
    weights = rerank.pairwise_perceptron(rows, ["good", "same"], epochs=3)
    assert weights == {"good": 0.15, "same": 0.0}
    assert rerank.pairwise_perceptron(rows.filter("label = 0"), ["good"]) == {"good": 0.0}


def test_rank_metrics_count_missing_targets(spark):
    r = rerank.rank_metrics(spark.createDataFrame([(1,), (0,), (None,), (60,)], "rank int")).first()
    assert (r.n, r.hit_10, r.hit_50, r.hit_100, r.coverage) == (4, 0.25, 0.25, 0.5, 0.5)
