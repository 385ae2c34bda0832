"""Exact top-k search of many vectors against many, by products of blocks, and dense recall of users built on it.

Both sides are dealt into blocks; each pair of blocks is one group of a cogrouped shuffle, which gives k rows per query and no more,
so no task holds a side. The cost is that of every exact search: all products are taken, and a side crosses the shuffle once
per block of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.operators.recall import top_k
from loomrec.operators.semantic import mean_vectors
from loomrec.operators.tables import stored

#: Rows of a block, and queries scored at once in it: 256 x 16,384 scores are 32 MB.
BLOCK_ROWS = 16_384
TILE = 256
#: Blocks of a search by inner products of few components (about 3 and 12 MB at 8 of them), and items scored at once.
PRODUCT_QUERIES, PRODUCT_ITEMS, PRODUCT_TILE = 65_536, 262_144, 4096


def usable(vectors: DataFrame, key: str, column: str, dims: int) -> DataFrame:
    """(id, vector) of the rows with an id and ``dims`` finite components, not all zero; others can't be compared and are left out."""
    v = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & (F.size("vector") == dims))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0))


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _unit(column: pd.Series) -> np.ndarray:
    m = np.array(column.to_list(), np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # so that no square leaves the range of a double
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(query: np.ndarray, item: np.ndarray, scores: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """The k best of each row of scores; ties go to the smaller item, of any number of them. ``item`` ascends."""
    n = min(k, scores.shape[1])
    bar = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    row, col = np.nonzero((scores >= bar[:, None]) & (scores > least))
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < n
    return pd.DataFrame({"query": query[row[keep]], "item": item[col[keep]], "score": value[keep]})


def block_scores(k: int, drop_self: bool, least: float):
    """Scores one block of queries (id, vector; or id and an item seen) against one block of items (id, vector): k rows a query."""

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asked, known = left[left["seen"].isna()], left[left["seen"].notna()]
        if asked.empty or right.empty:
            return pd.DataFrame({"query": np.array([], np.int64), "item": np.array([], np.int64), "score": np.array([], np.float64)})
        asked, right = asked.sort_values("id"), right.sort_values("id")
        q_id, i_id = asked["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        q, v = _unit(asked["vector"]), _unit(right["vector"]).T
        known = known.assign(seen=known["seen"].astype("int64")).sort_values("id")
        k_id, k_item = known["id"].to_numpy(np.int64), known["seen"].to_numpy(np.int64)
        parts = []
        for at in range(0, len(q), TILE):
            s, ids = np.round(q[at : at + TILE] @ v, 6), q_id[at : at + TILE]
            if drop_self:
                s[ids[:, None] == i_id[None, :]] = -2.0
            for row, one in enumerate(ids):
                mine = k_item[np.searchsorted(k_id, one) : np.searchsorted(k_id, one, "right")]
                if len(mine):
                    s[row, np.isin(i_id, mine)] = -2.0
            parts.append(_best(ids, i_id, s, k, least))
        return pd.concat(parts)

    return score


def block_top_k(queries: DataFrame, items: DataFrame, k: int, *, seen: DataFrame | None = None, drop_self: bool = False, least: float = 0.0, rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, item, score, rank): the k items of the greatest cosine (six decimals, above ``least``) for every query.

    queries, items: (id, vector) of ``usable``. seen: (query, item) pairs that take no place; each goes to the one pair of blocks that
    scores it. drop_self: equal ids aren't compared. Equal scores go by the smaller item. A repeated id of the items counts as often
    as it occurs. No queries or no items: no rows.
    """
    n_q, n_i = _blocks(queries, rows), _blocks(items, rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = queries.select(_block(F.col("id"), n_q).alias("a"), every(n_i).alias("b"), "id", "vector", F.lit(None).cast("long").alias("seen"))
    if seen is not None:
        s = seen.select(F.col("query").cast("long").alias("query"), F.col("item").cast("long").alias("item")).filter("query is not null and item is not null")
        asking = asking.unionByName(s.select(
            _block(F.col("query"), n_q).alias("a"), _block(F.col("item"), n_i).alias("b"), F.col("query").alias("id"), F.lit(None).cast("array<double>").alias("vector"), F.col("item").alias("seen")))
    offered = items.select(every(n_q).alias("a"), _block(F.col("id"), n_i).alias("b"), "id", "vector")

    found = asking.groupBy("a", "b").cogroup(offered.groupBy("a", "b")).applyInPandas(block_scores(k, drop_self, least), "query long, item long, score double")
    return top_k(found, ["query"], [F.col("score").desc(), F.col("item")], k)


def product_scores(k: int, tile: int):
    """The k items of the greatest inner product for each query of one block against one block of items.

    Items come by falling length, a tile at a time. A query keeps the k best so far; what is below the last of them is passed over,
    and a tile isn't scored for a query that its longest item can't help (product of lengths). All that a task needs is made in here, so
    that workers need no module of the repository."""
    kinds = {"query": np.int64, "item": np.int64, "score": np.float32}

    def matrix(table: pa.Table) -> np.ndarray:
        return table.column("vector").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(table.num_rows, -1)

    def first(row: np.ndarray, item: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k first of each row by falling value, then by item."""
        order = np.lexsort((item, -value, row))
        row, item, value = row[order], item[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], item[keep], value[keep]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: np.zeros(0, d) for n, d in kinds.items()})
        q, v = matrix(left), matrix(right)
        far = np.linalg.norm(v.astype(np.float64), axis=1)
        order = np.argsort(-far, kind="stable")
        v, far, ids = np.ascontiguousarray(v[order].T), far[order] * (1 + 1e-5), right.column("id").to_numpy()[order]
        reach, q_ids, parts = np.linalg.norm(q.astype(np.float64), axis=1), left.column("id").to_numpy(), []
        for at in range(0, len(q), TILE):
            mine, length = q[at : at + TILE], reach[at : at + TILE]
            bar = np.full(len(mine), -np.inf, np.float32)
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
            for i in range(0, len(ids), tile):
                alive = np.flatnonzero(length * far[i] >= bar)
                if not len(alive):
                    break
                s = mine[alive] @ v[:, i : i + tile]
                least = bar[alive]
                if s.shape[1] > k:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]) if i == 0 else least
                row, col = np.divmod(np.flatnonzero(s >= least[:, None]), s.shape[1])
                if not len(row):
                    continue
                found = alive[row], ids[i + col], s[row, col]
                best = first(*[np.concatenate(x) for x in zip(best, found)], k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(mine)) >= k)
                bar[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
            parts.append((q_ids[at + best[0]], best[1], best[2]))
        return pa.table({n: np.concatenate(c).astype(d) for (n, d), c in zip(kinds.items(), zip(*parts))})

    return score


def product_top_k(queries: DataFrame, items: DataFrame, k: int, query_rows: int = PRODUCT_QUERIES, item_rows: int = PRODUCT_ITEMS, tile: int = PRODUCT_TILE) -> DataFrame:
    """(query, item, score, rank): the k items of the greatest inner product for every query; equal ones go by the smaller item.

    queries, items: (id, vector), all of as many components. All products of what can still be among the best are taken, in float32;
    each pair of blocks is one group of a cogrouped shuffle and gives k rows a query, so no task holds a side.
    """
    n_q, n_i = _blocks(queries, query_rows), _blocks(items, item_rows)
    n_q = max(n_q, -(-queries.sparkSession.sparkContext.defaultParallelism // n_i))  # a task for each core
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col("id").cast("long").alias("id"), "vector"]
    asking = queries.select(_block(F.col("id"), n_q).alias("a"), every(n_i).alias("b"), *own).repartition(n_q * n_i, "a", "b")
    asked = items.select(every(n_q).alias("a"), _block(F.col("id"), n_i).alias("b"), *own).repartition(n_q * n_i, "a", "b")
    near = asking.groupBy("a", "b").cogroup(asked.groupBy("a", "b")).applyInArrow(product_scores(k, tile), "query long, item long, score float")
    return top_k(near, ["query"], [F.col("score").desc(), F.col("item")], k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """``block_top_k`` of any number of queries, self left out. Vectors of another size than the longest are left out, as unusable ones are."""
    dims = vectors.agg(F.max(F.size(column)).alias("d")).first()["d"] or 0
    return block_top_k(usable(queries, key, column, dims), usable(vectors, key, column, dims), k, drop_self=True, rows=rows)


@dataclass(frozen=True)
class Tower:
    """A residual layer: x + second . max(0, first . x + first_bias) + second_bias. Its size is the model's, not the data's."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x + np.maximum(x @ self.first.T + self.first_bias, 0.0) @ self.second.T + self.second_bias


def user_vectors(seeds: DataFrame, vectors: DataFrame, dims: int, tower: Tower | None = None, decay: float = 0.8) -> DataFrame:
    """(id, vector): the decayed mean of each user's seed vectors, sent through the tower. A user without one, or whose vector
    comes out as zero, is absent. seeds: (user_id, item_id, seed_rank); vectors: (id, vector) of ``usable``."""
    long = mean_vectors(seeds, vectors.select(F.col("id").alias("item_id"), "vector"), decay)
    means = long.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector"))
    if tower is None:
        return usable(means, "id", "vector", dims)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "vector": list(tower(np.array(pdf["vector"].to_list(), np.float64)))})

    return usable(means.mapInPandas(project, "id long, vector array<double>"), "id", "vector", dims)


def dense_recall(seeds: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, dims: int, tower: Tower | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """(user_id, item_id, score, rank): the unseen items nearest to each user's vector. seen: (user_id, item_id)."""
    items = usable(vectors, "item_id", "vector", dims)
    asking = stored(user_vectors(seeds, items, dims, tower), "users")  # counted, then joined
    found = block_top_k(asking, items, k, seen=seen.select(F.col("user_id").alias("query"), F.col("item_id").alias("item")), rows=rows)
    return found.select(F.col("query").alias("user_id"), F.col("item").alias("item_id"), "score", "rank")


def dense_coverage(recalled: DataFrame, seeds: DataFrame, vectors: DataFrame, k: int, dims: int) -> DataFrame:
    """(user_id, n_seeds, n_seed_vectors, n_found, reason) of every user with a seed; reason: no_seed_vector, nothing_found, below_target,
    or null where all k places are filled."""
    has = usable(vectors, "item_id", "vector", dims).select(F.col("id").alias("item_id")).distinct().withColumn("has", F.lit(1))
    per = seeds.join(has, "item_id", "left").groupBy("user_id").agg(F.count("*").alias("n_seeds"), F.count("has").alias("n_seed_vectors"))
    j = per.join(recalled.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").withColumn("n_found", F.coalesce("n", F.lit(0)).cast("long"))
    reason = F.when(F.col("n_seed_vectors") == 0, "no_seed_vector").when(F.col("n_found") == 0, "nothing_found").when(F.col("n_found") < k, "below_target")
    return j.select("user_id", "n_seeds", "n_seed_vectors", "n_found", reason.alias("reason"))
