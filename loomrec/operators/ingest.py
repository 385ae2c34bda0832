"""Ingest rules: conflict merge, caps, universes, row keys, shards, import plans, leakage checks, family samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrec.operators.recall import tokens


def merge_conflicts(rows: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row per key: each scalar is its first non-blank value in ``order``; lists are united and sorted. One shuffle,
    combined on the map side."""
    given = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(order))
    firsts = [F.min_by(c, given(c)).alias(c) for c in scalars]
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    return rows.groupBy(key).agg(*firsts, *unions, F.count("*").alias("n_rows"))


def ingest(rows: DataFrame, by: str, min_ts: int, cap: int) -> DataFrame:
    """Rows with valid ids and a time from ``min_ts`` on; the first ``cap`` per category (the cap is the feature)."""
    valid = rows.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & (F.col("ts") >= min_ts))
    return valid.withColumn("line", F.row_number().over(W.partitionBy(by).orderBy("ts", "ord"))).filter(F.col("line") <= cap)


def in_universe(rows: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose item, or whose (user, item, time), is in the universe."""
    return rows.join(universe.select(*keys).distinct(), keys, "left_semi")


def row_key(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def stable_shard(key: Column, shards: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % shards


def import_plan(rows: DataFrame, sources: set[str]) -> DataFrame:
    """(user_id, item_id, source, score, rank, accepted): rows of known sources with a finite score, ranked from 1 per user
    and source; others are kept with accepted = 0 and no rank."""
    good = F.col("source").isin(*sorted(sources)) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    flagged = rows.withColumn("accepted", F.coalesce(good, F.lit(False)).cast("int"))
    place = F.row_number().over(W.partitionBy("user_id", "source", "accepted").orderBy(F.col("score").desc(), "item_id"))
    return flagged.select("user_id", "item_id", "source", "score", F.when(F.col("accepted") == 1, place).alias("rank"), "accepted")


def window_catalog(events: DataFrame) -> DataFrame:
    """(item_id, in_train, n_windows, only_later) per item seen in any window."""
    seen = events.groupBy("item_id").agg(F.max((F.col("split") == "train").cast("int")).alias("in_train"), F.countDistinct("split").alias("n_windows"))
    return seen.withColumn("only_later", 1 - F.col("in_train"))


def reject_fields(df: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    """``df`` unchanged; ValueError if it carries a field that only an evaluation may know."""
    found = sorted(set(map(str.lower, df.columns)) & set(map(str.lower, forbidden)))
    if found:
        raise ValueError(f"forbidden fields: {found}")
    return df


def forbidden_scopes(payload: object, forbidden: set[str], path: str = "$") -> list[str]:
    """Paths inside a manifest whose key or text value names a forbidden scope."""
    if isinstance(payload, dict):
        own = [f"{path}.{k}" for k in payload if str(k).lower() in forbidden]
        return own + [p for k, v in payload.items() for p in forbidden_scopes(v, forbidden, f"{path}.{k}")]
    if isinstance(payload, list):
        return [p for i, v in enumerate(payload) for p in forbidden_scopes(v, forbidden, f"{path}[{i}]")]
    return [path] if isinstance(payload, str) and payload.lower() in forbidden else []


def family_sample(items: DataFrame, per_category: int, pool: int, similar: float = 0.65) -> DataFrame:
    """Per category, in hash order, the first ``per_category`` items of a pool of ``pool`` whose titles share less than
    ``similar`` (Jaccard of tokens) with every item already taken."""
    hashed = items.select("item_id", "category", tokens(F.coalesce("title", F.lit(""))).alias("t"), F.md5(F.col("item_id").cast("string")).alias("h"))
    bounded = hashed.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("h"))).filter(F.col("r") <= pool)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, set[str]]] = []
        for row in group.sort_values("r").itertuples():
            own = set(row.t)
            if len(taken) < per_category and all(len(own & t) < similar * max(1, len(own | t)) for _, t in taken):
                taken.append((row.item_id, own))
        return pd.DataFrame({"category": group["category"].iloc[0], "item_id": [i for i, _ in taken], "place": range(1, len(taken) + 1)})

    return bounded.groupBy("category").applyInPandas(pick, "category string, item_id long, place int")


def validated(outputs: dict[str, DataFrame], expected: dict[str, int]) -> list[str]:
    """Complaints: outputs that are missing or whose row count differs from the stated one."""
    missing = [f"{n}: missing" for n in expected if n not in outputs]
    counts: Iterator[tuple[str, int]] = ((n, outputs[n].count()) for n in expected if n in outputs)
    return missing + [f"{n}: {c} rows, {expected[n]} stated" for n, c in counts if c != expected[n]]
