"""Operators on literal fixtures: boundaries, ties, empty tables, greedy selectors against plain Python, streams."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from loomrec.operators import candidates, cleaning, evaluation, events, ranking, recall, retrieval, semantic
from loomrec.sources import files
from loomrec.streaming import feedback

SEQ = "user_id long, item_id long, row_num long, pos int, len int, strong int"
MERGED = "user_id long, item_id long, score double, sources string"


@pytest.mark.parametrize(("n", "sizes"), [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (10, (8, 1, 1)), (100, (80, 10, 10))])
def test_split_sizes(n, sizes):
    assert cleaning.split_sizes(n) == sizes


def test_calendar_windows_are_half_open(spark):
    df = spark.createDataFrame([(99,), (100,), (199,), (200,), (299,), (300,), (-1,)], "ts long")
    got = [r["s"] for r in df.select(cleaning.calendar_split(F.col("ts"), 100, 200, 300).alias("s")).collect()]
    assert got == ["train", "valid", "valid", "test", "test", None, None]


def test_labels_of_null_rating(spark):
    df = spark.createDataFrame([(None, True, 3), (4.0, True, 20), (3.9, False, 0)], "rating double, verified boolean, helpful long")
    got = [(r["label_binary"], r["label_strong"], round(float(r["label_strength"]), 6)) for r in cleaning.with_labels(df).collect()]
    assert got == [(0, 0, 0.26), (1, 1, 1.2), (0, 0, 0.78)]


def test_global_rank_crosses_hours(spark):
    rows = [(3_600_000 * (i % 5) + i, i) for i in range(50)]
    got = {r["id"]: r["row_num"] for r in cleaning.global_rank(spark.createDataFrame(rows, "ts long, id long"), "ts", ["id"]).collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted(rows))}


def test_modal_value_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (2, "z"), (2, "a")], "k long, v string")
    assert {(r["k"], r["modal_v"]) for r in cleaning.modal_value(df, "k", "v").collect()} == {(1, "a"), (2, "z")}


def test_k_core_reaches_a_fixpoint(spark):
    rows = [(u, i) for u in range(4) for i in range(4)] + [(9, 0), (9, 50), (8, 50)]
    got = {(r["user_id"], r["item_id"]) for r in cleaning.k_core(spark.createDataFrame(rows, "user_id long, item_id long"), 3, 3).collect()}
    assert got == {(u, i) for u in range(4) for i in range(4)}


def test_largest_remainder_sums():
    assert cleaning.largest_remainder({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}


def test_item_graph_golden(spark):
    # a, b, c in order with window 2: a->b (2/3)/1, a->c (3/3)/2, b->c (3/3)/1, c strong: times 1.5
    df = spark.createDataFrame([(1, 10, 1, 1, 3, 0), (1, 20, 2, 2, 3, 0), (1, 30, 3, 3, 3, 1)], SEQ)
    got = {(r["src"], r["dst"]): r["score"] for r in recall.item_graph(df, 2).collect()}
    assert got == {(10, 20): 0.666667, (10, 30): 0.75, (20, 30): 1.5}


def test_itemcf_golden_and_empty(spark):
    df = spark.createDataFrame([(u, i, 0, 1, 1, 0) for u, i in [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]], SEQ)
    got = {(r["src"], r["dst"]): (r["cooc"], r["score"]) for r in recall.itemcf(df).collect()}
    assert got == {(1, 2): (2, round(2 / math.sqrt(6), 6)), (2, 1): (2, round(2 / math.sqrt(6), 6))}
    assert recall.itemcf(df.limit(0), 5).count() == recall.swing(df.limit(0)).count() == recall.usercf(df.limit(0)).count() == 0


def test_swing_matches_the_double_loop(spark):
    owned = {1: {1, 2, 3}, 2: {1, 2}, 3: {2, 3, 4}, 4: {1, 2, 3, 4}}
    df = spark.createDataFrame([(u, i, 0, 1, 1, 0) for u, s in owned.items() for i in s], SEQ)
    want = {}
    for a in range(1, 5):
        for b in range(a + 1, 5):
            users = sorted(u for u, s in owned.items() if a in s and b in s)
            score = sum(1 / math.sqrt(len(owned[u]) * len(owned[v])) / (1 + len(owned[u] & owned[v])) for k, u in enumerate(users) for v in users[k + 1 :])
            if score:
                want[a, b] = round(score, 6)
    assert {(r["src"], r["dst"]): r["score"] for r in recall.swing(df).collect()} == want


def test_seeds_are_newest_first_and_unique(spark):
    df = spark.createDataFrame([(1, i, n, n + 1, 5, 0) for n, i in enumerate([7, 8, 9, 8, 6])], SEQ)
    got = [(r["item_id"], r["seed_rank"]) for r in candidates.seeds(df, 4).orderBy("seed_rank").collect()]
    assert got == [(6, 1), (8, 2), (9, 3)]


def test_pool_minimum_maximum_and_balance(spark):
    rows = [(1, i, 10.0 - i, s) for i, s in enumerate(["a", "a", "a", "a,b", "b", "c"])]
    df = spark.createDataFrame(rows, MERGED)
    got = [r["item_id"] for r in candidates.limit_pool(df, 4, {"c": 1}, {"a": 2}).orderBy("slot").collect()]
    assert got == [0, 1, 4, 5]
    got = [r["item_id"] for r in candidates.balanced_pool(df, 5, ["a", "b", "c"]).orderBy("slot").collect()]
    assert got == [0, 3, 5, 1, 4]


def test_merge_keeps_best_score_and_source_order(spark):
    one = spark.createDataFrame([(1, 5, 0.2), (1, 5, 0.4), (1, 6, 0.3)], "user_id long, item_id long, score double")
    got = {r["item_id"]: (r["score"], r["sources"]) for r in candidates.merge_sources({"x": one, "b": one.filter("item_id = 5")}).collect()}
    assert got == {5: (0.8, "x,b"), 6: (0.3, "x")}


def test_min_max_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "user_id long, v double")
    assert sorted(r["s"] for r in ranking.min_max(df, "v", "s").collect()) == [0.0, 0.0, 0.0, 1.0]


def test_greedy_screen_and_feed(spark):
    ranked = spark.createDataFrame([(1, i, i + 1, 1.0 - i / 100) for i in range(10)], "user_id long, item_id long, final_rank int, final double")
    items = spark.createDataFrame([(i, f"title {i % 2}", "c" if i < 7 else "d", f"b{i % 5}") for i in range(10)], "item_id long, title string, category string, brand string")
    order = [r["item_id"] for r in ranking.first_screen(ranked, items).orderBy("place").collect()]
    assert order[:7] == [0, 1, 2, 3, 7, 8, 9] and sorted(order) == list(range(10))
    feed = [r["item_id"] for r in ranking.marginal_relevance(ranked, items, 4).orderBy("place").collect()]
    assert len(set(feed)) == 4 and feed[0] == 0 and feed[1] in (7, 9)


def test_feature_gate(spark):
    with pytest.raises(ValueError, match="not allowed"):
        ranking.check_features(spark.createDataFrame([(1, 2)], "pop int, label_binary int"), {"pop", "label_binary"}, set())


def test_metrics_golden(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3), (2, 10, 1)], "user_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 20), (1, 99), (3, 1)], "user_id long, item_id long")
    r = evaluation.ranking_metrics(ranked, truth, 3).first()
    ideal = 1 + 1 / math.log2(3)
    assert (r["n_users"], r["recall"], r["mrr"], r["map"], r["hit_rate"]) == (2, 0.25, 0.25, 0.125, 0.5)
    assert r["ndcg"] == round((1 / math.log2(3) / ideal) / 2, 6)


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(6)], "g string, v double")
    assert evaluation.nearest_rank(df, "g", "v", 0.5).first()["nearest"] == 2.0


def test_quota_skips_take_nothing(spark):
    rows = [(1, 1, "t", n, 10.0 - n) for n in range(4)] + [(1, 1, "d", 9, 1.0)]
    df = spark.createDataFrame(rows, "query long, item_id long, field string, chunk_no long, score double")
    assert {r["chunk_no"] for r in retrieval.evidence_quota(df, 2, 3).collect()} == {0, 1, 9}


def test_chunks_pack_sentences(spark):
    df = spark.createDataFrame([(1, "Aa bb. Cc dd. " + "x" * 30 + "."), (2, ""), (3, None)], "id long, text string")
    got = [r["chunk"] for r in retrieval.chunk_records(df, "id", "text", 14).orderBy("chunk_no").collect()]
    assert got == ["Aa bb. Cc dd.", "x" * 30 + "."]


def test_stock_guard_refuses_in_order(spark):
    df = spark.createDataFrame([(1, 6, 1), (1, 5, 2), (1, 4, 3)], "item_id long, qty long, ord long")
    assert tuple(events.guarded_stock(df, 10).first()) == (1, 0, 2, 1)


def test_preference_expires_exactly_at_its_age(spark):
    now = datetime.datetime(2024, 7, 1)
    rows = [(1, now - datetime.timedelta(days=180), 1, "LIKE", 5), (2, now - datetime.timedelta(days=179), 1, "DISLIKE", 6)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, profile_id long, kind string, item_id long")
    assert [r["item_id"] for r in events.preferences(df, F.lit(now)).collect()] == [6]


def test_stream_equals_batch_and_ignores_old_versions(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=i % 7), i % 3, ["LIKE", "DISLIKE", "CLICK"][i % 3 if i % 5 else 1], i % 4) for i in range(40)]
    schema = "event_id long, ts timestamp, profile_id long, kind string, item_id long"
    for n, part in enumerate((rows[20:], rows[:20])):  # the later half comes first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    states = {}

    def keep(df, _):
        for r in df.collect():
            states[r["profile_id"], r["item_id"]] = (r["kind"], r["version"])

    for n in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in*"))
        q = feedback.preference_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = {}
    for e, _, p, k, i in rows:
        if k != "CLICK":
            want[p, i] = (k, e)
    assert states == want


def test_stream_dedup_and_windows(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, profile_id long, kind string, item_id long"
    spark.createDataFrame([(i % 5, t, 1, "LIKE", 1) for i in range(10)], schema).write.parquet(str(tmp_path / "in"))
    q = feedback.deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 5
    q = feedback.hourly_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] >= 10


def test_publish_upsert_lookup(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, version long")
    path = str(tmp_path / "t")
    assert files.publish(df, path) == 2
    with pytest.raises(ValueError, match="exceed"):
        files.publish(df, path, max_rows=1)
    assert spark.read.parquet(path).count() == 2
    merged = files.upsert(df, spark.createDataFrame([(2, "c", 2), (3, "d", 1)], df.schema), ["k"], "version")
    assert {(r["k"], r["v"]) for r in merged.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    files.keyed_layouts(df, str(tmp_path / "l"), {"by_k": ["k"]}, 4)
    assert files.point_lookup(spark, str(tmp_path / "l"), "by_k", {"k": 2}, 4).first()["v"] == "b"
    with pytest.raises(ValueError, match="outside"):
        files.manifest_scan(spark, str(tmp_path), {"x": "../y"}, "a long")


def test_common_title_tokens_count(spark):
    titles = {i: ["red box", "red tin", "blue tin", "blue box lid"][i % 4] for i in range(1000)}  # each token: 250 to 500 items
    items = spark.createDataFrame([(i, t, f"c{i % 3}") for i, t in titles.items()], "item_id long, title string, category string")
    seeds = {1: [0, 5], 2: [2], 3: [7, 1, 4]}
    seed = spark.createDataFrame([(u, i, r + 1) for u, own in seeds.items() for r, i in enumerate(own)], "user_id long, item_id long, seed_rank int")
    words = {i: set(t.split()) for i, t in titles.items()}
    for u, own in seeds.items():
        score = {i: max(len(words[i] & words[s]) for s in own) for i in titles if i not in own}
        best = sorted((-n, i) for i, n in score.items() if n)[:20]
        got = candidates.token_overlap(seed, items, 20, 3).filter(F.col("user_id") == u).orderBy("rank").collect()
        assert [(-r["score"], r["item_id"]) for r in got] == best
    idf = {t: math.log(1001 / (sum(t in w for w in words.values()) + 1)) for t in set().union(*words.values())}
    got = semantic.idf_overlap(seed, items, 20).collect()
    for s in sorted({i for own in seeds.values() for i in own}):
        shared = {i: words[i] & words[s] for i in titles if i != s}
        score = {i: round(sum(idf[t] for t in w) / len(w) + 0.5 * (i % 3 == s % 3), 6) for i, w in shared.items() if w}
        assert [(r["item_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["seed"] == s] == [(i, x) for x, i in sorted(((x, i) for i, x in score.items()), key=lambda y: (-y[0], y[1]))[:20]]
