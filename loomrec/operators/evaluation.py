"""Offline metrics and diagnostics over ranked lists and held-out positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Users, recall, NDCG, MRR, MAP and hit rate at k over users with held-out positives; (user_id, item_id, rank) against
    (user_id, item_id). With ``by`` (a column of truth) per segment and, null, over all."""
    held = truth.select("user_id", "item_id", *([by] if by else [])).distinct()
    users = held.groupBy("user_id", *([by] if by else [])).agg(F.count("*").alias("m"))
    hits = ranked.filter(F.col("rank") <= k).join(held.select("user_id", "item_id"), ["user_id", "item_id"])
    hits = hits.withColumn("h", F.row_number().over(W.partitionBy("user_id").orderBy("rank")))
    per = hits.groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"), F.sum(F.col("h") / F.col("rank")).alias("ap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    j = users.join(per, "user_id", "left").select(
        *([by] if by else []), (z("hits") / F.col("m")).alias("r"), (z("dcg") / ideal).alias("n"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (z("ap") / F.least(F.col("m"), F.lit(k))).alias("map"), (z("hits") > 0).cast("double").alias("hit"))
    rd = lambda c, name: F.round(F.avg(c), 6).alias(name)
    aggs = [F.count("*").alias("n_users"), rd("r", "recall"), rd("n", "ndcg"), rd("mrr", "mrr"), rd("map", "map"), rd("hit", "hit_rate")]
    return j.rollup(by).agg(*aggs) if by else j.agg(*aggs)


def recall_at_cutoffs(ranked: DataFrame, truth: DataFrame, cutoffs: list[int]) -> DataFrame:
    held = truth.select("user_id", "item_id").distinct()
    total = held.groupBy("user_id").agg(F.count("*").alias("m"))
    cuts = F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff")
    hits = ranked.join(held, ["user_id", "item_id"]).select("user_id", "rank")
    per = total.select("user_id", "m", cuts).join(hits, "user_id", "left").groupBy("user_id", "cutoff", "m").agg(F.count_if(F.col("rank") <= F.col("cutoff")).alias("h"))
    return per.groupBy("cutoff").agg(F.round(F.avg(F.col("h") / F.col("m")), 6).alias("recall"), F.round(F.avg((F.col("h") > 0).cast("double")), 6).alias("hit_rate"))


def source_marginal(long: DataFrame, truth: DataFrame) -> DataFrame:
    """Per source: users with a hit, and users who'd have none without it."""
    hit = long.join(truth.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi").select("user_id", "source").distinct()
    n = hit.withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    return n.groupBy("source").agg(F.count("*").alias("hit_users"), F.count_if(F.col("n") == 1).alias("only_here"))


def source_jaccard(long: DataFrame) -> DataFrame:
    sets = long.select("source", "user_id", "item_id").distinct()
    size = sets.groupBy("source").agg(F.count("*").alias("n"))
    a, b = sets.select(F.col("source").alias("a"), "user_id", "item_id"), sets.select(F.col("source").alias("b"), "user_id", "item_id")
    both = a.join(b, ["user_id", "item_id"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = both.join(size.select(F.col("source").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("source").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def nearest_rank(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """Value at index round_half_even((n - 1) * p) of each group in order."""
    w = W.partitionBy(by)
    r = df.select(by, value, F.row_number().over(w.orderBy(value)).alias("i"), F.count("*").over(w).alias("n"))
    return r.filter(F.col("i") - 1 == F.bround((F.col("n") - 1) * p, 0)).select(by, F.col("n"), F.col(value).alias("nearest"))


def miss_stage(truth: DataFrame, ranked: DataFrame, pool: DataFrame, raw: DataFrame, k: int) -> DataFrame:
    """Where each held-out positive was lost: in the top k, in the pool, recalled, or missed."""
    mark = lambda df, name: df.select("user_id", "item_id").distinct().withColumn(name, F.lit(1))
    j = truth.select("user_id", "item_id").distinct()
    for df, name in ((ranked.filter(F.col("rank") <= k), "t"), (pool, "p"), (raw, "r")):
        j = j.join(mark(df, name), ["user_id", "item_id"], "left")
    stage = F.when(F.col("t") == 1, "topk").when(F.col("p") == 1, "pool").when(F.col("r") == 1, "raw").otherwise("miss")
    return j.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def popularity_buckets(truth: DataFrame, pop: DataFrame) -> DataFrame:
    head = pop.orderBy(F.col("pop").desc(), "item_id").limit(200).select("item_id", "pop")
    ranked = head.withColumn("r", F.row_number().over(W.orderBy(F.col("pop").desc(), "item_id"))).select("item_id", "r")  # 200 rows
    j = truth.join(F.broadcast(ranked), "item_id", "left")
    bucket = F.when(F.col("r") <= 10, "top_10").when(F.col("r") <= 50, "top_50").when(F.col("r").isNotNull(), "beyond_50").otherwise("not_in_top")
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def graded_ndcg(ranked: DataFrame, gain: Column, k: int) -> DataFrame:
    """NDCG of graded gains per user: (2^g - 1) / log2(rank + 1) against the best order of the same list."""
    r = ranked.filter(F.col("rank") <= k).withColumn("g", F.pow(F.lit(2.0), gain) - 1)
    r = r.withColumn("best", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("g").desc(), "item_id")))
    d = r.groupBy("user_id").agg(F.sum(F.col("g") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("g") / F.log2(F.col("best") + 1.0)).alias("ideal"))
    return d.select("user_id", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def error_metrics(predicted: DataFrame) -> DataFrame:
    e = F.col("rating") - F.col("predicted")
    return predicted.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


def promotion_gate(runs: list[dict], metric: str, least_runs: int = 3, least_gain: float = 0.0) -> dict:
    gains = [r[metric] - r[f"baseline_{metric}"] for r in runs]
    blocked = [s for r in runs for s, v in r.get("segments", {}).items() if v < 0]
    return {"promote": len(runs) >= least_runs and all(g > least_gain for g in gains) and not blocked, "gains": gains, "blocked": blocked}


def bootstrap_interval(diffs: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean of ``diff``: each row draws its Poisson(1) multiplicity in every resample from a hash, so
    resamples are sums over partitions and no task holds all rows."""
    u = F.pmod(F.xxhash64(F.lit(seed), "user_id", "b"), F.lit(1_000_003)) / 1_000_003.0
    times = F.lit(0)
    acc = 0.0
    p = 2.718281828459045**-1
    for n in range(6):
        acc += p
        p /= n + 1
        times = times + (u >= acc).cast("int")
    rows = diffs.select("user_id", "diff", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("t", times)
    means = rows.groupBy("b").agg((F.sum(F.col("t") * F.col("diff")) / F.sum("t")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg("m").alias("mean"))


def restricted_hit_rate(long: DataFrame, truth: DataFrame, allowed: set[str], k: int) -> DataFrame:
    """(n_users, hit_users, hit_rate) of the lists re-ranked with some sources only, best score first."""
    w = W.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id")
    best = long.filter(F.col("source").isin(*sorted(allowed))).groupBy("user_id", "item_id").agg(F.max("score").alias("score"))
    top = best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    hit = top.join(truth.distinct(), ["user_id", "item_id"], "left_semi").select("user_id").distinct().withColumn("hit", F.lit(1))
    users = truth.select("user_id").distinct().join(hit, "user_id", "left")
    return users.agg(F.count("*").alias("n_users"), F.count("hit").alias("hit_users"), F.round(F.count("hit") / F.count("*"), 6).alias("hit_rate"))


def list_signature(ranked: DataFrame) -> DataFrame:
    """sha256 of each user's list in rank order: freezes candidates between runs."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"].cast("string")), ",")
    return ranked.groupBy("user_id").agg(F.sha2(ordered, 256).alias("signature"), F.count("*").alias("n"))


def stage_latency(spans: DataFrame, stage: str, value: str) -> DataFrame:
    """Average and nearest-rank p95 per stage, and over all rows (stage 'total')."""
    both = spans.select(F.explode(F.array(F.col(stage), F.lit("total"))).alias("stage"), F.col(value).alias("value"))
    average = both.groupBy("stage").agg(F.round(F.avg("value"), 4).alias("average"))
    return nearest_rank(both, "stage", "value", 0.95).join(average, "stage").select("stage", "n", "average", F.col("nearest").alias("p95"))


def diagnostic_gate(stages: DataFrame) -> DataFrame:
    """The bottleneck of a run from its (stage, n): recall if most targets are missed, ranking if most are found but not on
    top, otherwise none."""
    n = lambda *names: F.sum(F.when(F.col("stage").isin(*names), F.col("n")).otherwise(0))
    total = F.sum("n")
    lost = F.when(n("miss") * 2 > total, "recall").when(n("pool", "raw") > n("topk"), "ranking").otherwise("none")
    return stages.agg(total.alias("targets"), n("miss").alias("missed"), n("topk").alias("on_top"), lost.alias("bottleneck"))


def marginal_over_baseline(source: DataFrame, baseline: DataFrame, truth: DataFrame) -> DataFrame:
    """Targets and users that the source reaches and the baseline does not."""
    extra = source.select("user_id", "item_id").distinct().join(baseline.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    hits = extra.join(truth.distinct(), ["user_id", "item_id"], "left_semi")
    n = extra.agg(F.count("*").alias("extra_rows"))
    return n.crossJoin(hits.agg(F.count("*").alias("extra_hits"), F.countDistinct("user_id").alias("extra_users")))  # one row each


def shadow_comparison(variant: DataFrame, baseline: DataFrame, k: int = 10) -> DataFrame:
    """Per user: size of the variant's top k, items new against the baseline's top k, largest rank change of the others."""
    b = baseline.filter(F.col("rank") <= k).select("user_id", "item_id", F.col("rank").alias("b"))
    j = variant.filter(F.col("rank") <= k).select("user_id", "item_id", "rank").join(b, ["user_id", "item_id"], "left")
    return j.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("b").isNull().cast("int")).alias("n_new"), F.max(F.abs(F.col("rank") - F.col("b"))).alias("largest_move"))


def session_scorecard(turns: DataFrame) -> DataFrame:
    """Five dimensions per session: length, balance of roles, share of non-empty turns, average length, reward (the sum of
    1 per answered user turn less 0.1 per further turn)."""
    by = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.round(F.avg((F.length(F.coalesce("text", F.lit(""))) > 0).cast("int")), 6).alias("filled"), F.round(F.avg(F.length(F.coalesce("text", F.lit("")))), 4).alias("avg_chars"),
    )
    answered = F.least("n_user", "n_assistant")
    return by.withColumn("reward", F.round(answered - 0.1 * (F.col("n_turns") - answered), 6))
