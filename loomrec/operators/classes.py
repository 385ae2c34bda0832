"""Searches between classes of rows with equal content, exact for every row: copies cost one row, not one each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.operators.recall import top_k


def class_heads(rows: DataFrame, content: list[str], key: str, k: int) -> DataFrame:
    """(content, first, n, heads) of every class: rows of equal ``content``, which may not be null. first: the smallest key; n: rows;
    heads: the k smallest keys, so no list grows with its class. ``key`` is unique."""
    sizes = rows.groupBy(*content).agg(F.min(key).alias("first"), F.count("*").alias("n"))
    heads = top_k(rows.select(*content, key), content, [F.col(key)], k, "place").groupBy(*content).agg(F.sort_array(F.collect_list(key)).alias("heads"))
    return sizes.join(heads, content)


def best_members(scored: DataFrame, heads: DataFrame, by: list[str], key: str, k: int, score: Column | None = None) -> DataFrame:
    """The k best rows of each ``by``, by ``score`` (default: the column), equal ones by key, from the classes' scores (by, first,
    score, ...); adds ``rank``. A row among the k best lies in one of the k classes with the best score and first key, as each class
    before its own holds a row before it."""
    score = F.col("score") if score is None else score
    near = top_k(scored, by, [score.desc(), F.col("first")], k, "place").drop("place")
    rows = near.join(heads.select("first", F.explode("heads").alias(key)), "first").drop("first")
    return top_k(rows, by, [score.desc(), F.col(key)], k)
