"""Feature and model reranking, the cold ranker, the pairwise perceptron, metrics over ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrec.operators.recall import top_k


def source_features(sources: Column) -> dict[str, Column]:
    """0/1 features of a comma-joined source list."""
    own = F.split(sources, ",")
    return {
        "multi_source": (F.size(own) >= 2).cast("int"), "itemcf_source": F.array_contains(own, "itemcf").cast("int"),
        "category_only": (sources == "category").cast("int"), "popular_only": (sources == "popular").cast("int"),
    }


def feature_rerank(rows: DataFrame, features: dict[str, Column], weights: dict[str, float], score: str) -> DataFrame:
    """Adds the weighted features to a score; ``delta`` is what they add, ``rerank`` the new place per user."""
    delta = F.lit(0.0)
    for name, weight in weights.items():
        delta = delta + features[name] * F.lit(weight)
    new = rows.withColumns({n: c for n, c in features.items() if n in weights}).withColumn("delta", F.round(delta, 6))
    new = new.withColumn("reranked", F.round(F.col(score) + F.col("delta"), 6))
    return new.withColumn("rerank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("reranked").desc(), "item_id")))


def model_rerank(rows: DataFrame, score: str, linear: Column, deep: Column, deep_limit: int | None = None) -> DataFrame:
    """score + linear model + deep model, each rounded; with a limit only a user's first rows by score get the deep model's part."""
    r = rows.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.col(score).desc(), "item_id")))
    inside = F.lit(True) if deep_limit is None else F.col("place") <= deep_limit
    r = r.withColumn("ltr_score", F.round(linear, 6)).withColumn("deep_score", F.when(inside, F.round(deep, 6)).otherwise(0.0))
    r = r.withColumn("model_final", F.round(F.col(score) + F.col("ltr_score") + F.col("deep_score"), 6)).drop("place")
    return r.withColumn("model_rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("model_final").desc(), "item_id")))


def cold_rank(rows: DataFrame, score: Column, candidate_rank: str, n: int) -> DataFrame:
    """The n best rows per user by a cheap score; ties by candidate rank, then item."""
    return top_k(rows.withColumn("cold_score", F.round(score, 6)), ["user_id"], [F.col("cold_score").desc(), F.col(candidate_rank).asc_nulls_last(), F.col("item_id")], n, "cold_rank")


def survival(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows and positives (label 1) before and after a cut, and the share of positives that survived it."""
    count = lambda df, t: df.agg(F.count("*").alias(f"rows_{t}"), F.count_if(F.col("label") == 1).alias(f"positive_{t}"))
    j = count(rows, "before").crossJoin(F.broadcast(count(kept, "after")))
    share = F.when(F.col("positive_before") > 0, F.round(F.col("positive_after") / F.col("positive_before"), 6)).otherwise(0.0)
    return j.withColumn("positive_survival", share)


def pairwise_perceptron(rows: DataFrame, features: list[str], epochs: int = 5, rate: float = 0.05, negatives: int = 20, margin: float = 1.0) -> dict[str, float]:
    """Weights that put a user's positives (label 1) before negatives by a margin.

    A pair is a positive and one of the user's first ``negatives`` negatives (by item id; this sampling is the method's own). Each
    epoch is one distributed aggregation over all pairs: the weights move by ``rate`` times the mean difference of the pairs
    within the margin. Updates pair by pair in file order would tie every pair to the one before it, so this is the batch form.
    """
    pos = rows.filter("label = 1").select("user_id", *[F.col(f).cast("double").alias(f"p_{f}") for f in features])
    neg = top_k(rows.filter("label != 1"), ["user_id"], [F.col("item_id")], negatives, "n").select("user_id", *[F.col(f).cast("double").alias(f"n_{f}") for f in features])
    pairs = pos.join(neg, "user_id").select(*[(F.col(f"p_{f}") - F.col(f"n_{f}")).alias(f) for f in features]).persist()
    weights = dict.fromkeys(features, 0.0)
    for _ in range(epochs):
        gap = sum((F.col(f) * F.lit(weights[f]) for f in features), F.lit(0.0))
        close = gap <= margin
        got = pairs.agg(F.count_if(close).alias("moved"), *[F.sum(F.when(close, F.col(f))).alias(f) for f in features]).first()
        if not got["moved"]:
            break
        for f in features:
            weights[f] += rate * got[f] / got["moved"]
    pairs.unpersist()
    return {f: round(w, 10) for f, w in weights.items()}


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """One row over targets (rank from 1, 0 or null if not found): hit@10/50/100, coverage, MRR, NDCG@100."""
    r = F.when(F.col("rank") > 0, F.col("rank"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return ranks.agg(
        F.count("*").alias("n"), share(r <= 10).alias("hit_10"), share(r <= 50).alias("hit_50"), share(r <= 100).alias("hit_100"), share(r.isNotNull()).alias("coverage"),
        F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(r <= 100, 1 / F.log2(r + 1)).otherwise(0.0)), 6).alias("ndcg_100"))
