"""Candidate generation per user: seeds, edge recall, fallbacks, merge, pool limits. All users in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrec.operators.recall import tokens, top_k
from loomrec.operators.streamed import in_order


def seeds(events: DataFrame, last: int = 5) -> DataFrame:
    """(user_id, item_id, seed_rank): a user's last events, newest first, each item once."""
    back = events.withColumn("back", F.col("len") - F.col("pos") + 1).filter(F.col("back") <= last)
    one = back.groupBy("user_id", "item_id").agg(F.min("back").alias("back"))
    return one.withColumn("seed_rank", F.row_number().over(W.partitionBy("user_id").orderBy("back"))).select("user_id", "item_id", "seed_rank")


def unseen(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """The hits on items that the user hasn't seen. Seen items are one list a user, so that hits are dealt by user alone and
    what follows, per user and item or per user, needs no further shuffle."""
    own = seen.groupBy("user_id").agg(F.collect_set("item_id").alias("__seen"))
    j = hits.join(own, "user_id", "left")
    return j.filter(~F.coalesce(F.array_contains("__seen", F.col("item_id")), F.lit(False))).drop("__seen")


def recall_from_edges(seed: DataFrame, edges: DataFrame, seen: DataFrame, weight: Column, per_seed: int, k: int, how: str = "max", floor: float = 0.0) -> DataFrame:
    """(user_id, item_id, score, rank) over ranked edges of the seeds, scored weight(seed_rank) * edge, best or summed per
    item, above a floor, unseen only."""
    short = edges.filter(F.col("rank") <= per_seed).select(F.col("src").alias("item_id"), "dst", F.col("score").alias("edge"))
    hits = seed.join(short, "item_id").withColumn("s", weight * F.col("edge")).select("user_id", F.col("dst").alias("item_id"), "s")
    hits = unseen(hits, seen)
    agg = {"max": F.max, "sum": F.sum}[how]
    scored = hits.groupBy("user_id", "item_id").agg(F.round(agg("s"), 6).alias("score")).filter(F.col("score") > floor)
    return top_k(scored, ["user_id"], [F.col("score").desc(), F.col("item_id")], k)


def from_buckets(profile: DataFrame, buckets: DataFrame, seen: DataFrame, per_bucket: int, k: int) -> DataFrame:
    """Best unseen items of the user's categories: popularity * (1 + share) + 0.01 * recent."""
    main = buckets.filter((F.col("rank") <= per_bucket) & F.col("bucket").startswith("main::")).select(F.regexp_replace("bucket", "^main::", "").alias("category"), "item_id", "pop", "recent_pop")
    hits = unseen(profile.select("user_id", "category", "share").join(main, "category"), seen)
    scored = hits.select("user_id", "item_id", F.round(F.col("pop") * (1 + F.col("share")) + 0.01 * F.col("recent_pop"), 6).alias("score"))
    return top_k(scored, ["user_id"], [F.col("score").desc(), F.col("item_id")], k)


def long_tail(profile: DataFrame, items: DataFrame, pop: DataFrame, beyond: int, per_category: int) -> DataFrame:
    """Items below a popularity rank inside each of the user's categories."""
    ranked = items.select("item_id", "category").join(pop.select("item_id", "pop"), "item_id", "left").na.fill(0, ["pop"])
    r = ranked.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy(F.col("pop").desc(), "item_id"))).filter((F.col("r") > beyond) & (F.col("r") <= beyond + per_category))
    return profile.select("user_id", "category").join(r, "category").select("user_id", "item_id", "category", "r")


def token_overlap(seed: DataFrame, items: DataFrame, k: int, last: int) -> DataFrame:
    """Unseen items that share title tokens with one of a user's first ``last`` seeds; every token counts, however common.

    Items of equal token sets are one class: overlaps are counted between classes, so a common token costs pairs of classes,
    not of items. Of a class, and of a seed's class, only the first k items beyond the user's seeds can be among the best k.
    """
    own = items.select("item_id", F.array_join(F.sort_array(tokens(F.col("title"), 3)), " ").alias("bag")).filter("bag != ''")
    words = own.select("bag").distinct().select("bag", F.explode(F.split("bag", " ")).alias("token"))
    asked = seed.filter(F.col("seed_rank") <= last).join(own, "item_id").select("user_id", F.col("bag").alias("seed_bag"))
    asked_words = asked.select("seed_bag").distinct().select("seed_bag", F.explode(F.split("seed_bag", " ")).alias("token"))
    overlap = asked_words.join(words, "token").groupBy("seed_bag", "bag").agg(F.count("*").alias("overlap"))
    first = top_k(own, ["bag"], [F.col("item_id")], k + last, "place").select("bag", "item_id")
    near = top_k(overlap.join(first, "bag"), ["seed_bag"], [F.col("overlap").desc(), F.col("item_id")], k + last, "place").select("seed_bag", "item_id", "overlap")
    best = asked.join(near, "seed_bag").groupBy("user_id", "item_id").agg(F.max("overlap").alias("score"))
    best = best.join(seed.filter(F.col("seed_rank") <= last).select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_k(best, ["user_id"], [F.col("score").desc(), F.col("item_id")], k)


def popular_fallback(users: DataFrame, pop: DataFrame, seen: DataFrame, n: int, k: int) -> DataFrame:
    """The first k unseen of the n most popular items for each user; n rows are broadcast."""
    head = pop.orderBy(F.col("pop").desc(), "item_id").limit(n).select("item_id", "pop")
    open_rows = unseen(users.crossJoin(F.broadcast(head)), seen)
    return top_k(open_rows, ["user_id"], [F.col("pop").desc(), F.col("item_id")], k)


def merge_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per user and item: the best score of each source, sources in the order given, ranked by the sum of the scores in
    millionths: whole numbers, so that their order doesn't matter. A source is a column of its own, so one hash aggregate does it."""
    long = None
    for i, (name, df) in enumerate(parts.items()):
        p = df.select("user_id", "item_id", F.col("score").cast("double").alias("score"), F.lit(i).alias("src_no"))
        long = p if long is None else long.unionByName(p)
    at = lambda i: F.col("src_no") == i
    n = range(len(parts))
    best = long.groupBy("user_id", "item_id").agg(*[F.max(F.when(at(i), F.floor(F.col("score") * 1e6 + 0.5))).alias(f"s{i}") for i in n], *[F.max(at(i)).alias(f"in{i}") for i in n])
    total = sum((F.coalesce(f"s{i}", F.lit(0)) for i in n), F.lit(0))
    merged = best.select(
        "user_id", "item_id", F.when(F.coalesce(*[f"s{i}" for i in n]).isNotNull(), total / 1e6).alias("score"),
        F.concat_ws(",", *[F.when(F.col(f"in{i}"), name) for i, name in enumerate(parts)]).alias("sources"), sum((F.col(f"in{i}").cast("long") for i in n), F.lit(0)).cast("long").alias("n_sources"))
    return merged.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id")))


def canonical_sources(df: DataFrame, aliases: dict[str, str], forbidden: set[str]) -> DataFrame:
    """Maps source labels by an alias table and refuses forbidden ones."""
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return df.withColumn("source", F.coalesce(m[F.col("source")], F.col("source"))).filter(~F.col("source").isin(*forbidden))


POOL = "user_id long, item_id long, score double, sources string, slot int"


def _pools(merged: DataFrame, run: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``run`` picks from a user's rows (user_id, item_id, score, sources), best first; picks are numbered."""
    slots = lambda rows: [(*row, i) for i, row in enumerate(run(rows), 1)]
    return in_order(merged.select("user_id", "item_id", "score", "sources"), "user_id", [F.col("score").desc(), F.col("item_id")], slots, POOL)


def limit_pool(merged: DataFrame, size: int, minimums: dict[str, int], maximums: dict[str, int]) -> DataFrame:
    """Greedy pool per user: source minimums first, then by score, never beyond a source's maximum. Each pick changes what
    may follow, so a task streams the users' sorted rows (a user's pool is bounded by the recall limits)."""

    def run(rows: list[tuple]) -> list[tuple]:
        own = [row[3].split(",") for row in rows]
        taken: set[int] = set()
        counts = dict.fromkeys([*minimums, *maximums], 0)

        def take(i: int) -> None:
            if i not in taken and all(counts[s] < m for s, m in maximums.items() if s in own[i]):
                taken.add(i)
                for s in counts:
                    counts[s] += s in own[i]

        for source, least in minimums.items():
            for i in range(len(rows)):
                if counts[source] >= least or len(taken) >= size:
                    break
                if source in own[i]:
                    take(i)
        for i in range(len(rows)):
            if len(taken) >= size:
                break
            take(i)
        return [rows[i] for i in sorted(taken)]

    return _pools(merged, run)


def balanced_pool(merged: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Round-robin over sources: the best untaken item of each in turn, until the pool is full."""

    def run(rows: list[tuple]) -> list[tuple]:
        own = [row[3].split(",") for row in rows]
        queues = {s: iter([i for i in range(len(rows)) if s in own[i]]) for s in order}
        taken: dict[int, tuple] = {}
        added = True
        while added and len(taken) < size:
            added = False
            for s in order:
                i = next((i for i in queues[s] if i not in taken), None)
                if i is not None and len(taken) < size:
                    taken[i] = rows[i]
                    added = True
        return list(taken.values())

    return _pools(merged, run)


def fill_ladder(steps: list[DataFrame], target: int) -> DataFrame:
    """Rows of earlier steps first, later steps only into free slots; an item counts once, at its earliest step."""
    long = None
    for i, df in enumerate(steps):
        p = df.select("user_id", "item_id", F.lit(i).alias("step"), F.col("rank").cast("long").alias("ord"))
        long = p if long is None else long.unionByName(p)
    one = long.groupBy("user_id", "item_id").agg(F.min(F.struct("step", "ord")).alias("m")).select("user_id", "item_id", "m.step", "m.ord")
    return top_k(one, ["user_id"], [F.col("step"), F.col("ord"), F.col("item_id")], target, "slot")


def diverse_popular(items: DataFrame, pop: DataFrame, per_category: int, n: int) -> DataFrame:
    """Popular items with a cap per category; what exceeds the cap comes after all others."""
    j = pop.join(items.select("item_id", "category"), "item_id")
    r = j.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy(F.col("pop").desc(), "item_id")))
    order = [(F.col("r") > per_category).cast("int"), F.col("pop").desc(), F.col("item_id")]
    return r.orderBy(*order).limit(n).select("item_id", "category", "pop", F.col("r").alias("category_rank"))


def interleave(pools: list[DataFrame], n: int) -> DataFrame:
    """Round-robin by place across pools; an item keeps its first place."""
    long = None
    for i, df in enumerate(pools):
        p = df.select("user_id", "item_id", F.struct(F.col("rank").cast("long").alias("r"), F.lit(i).alias("p")).alias("at"))
        long = p if long is None else long.unionByName(p)
    one = long.groupBy("user_id", "item_id").agg(F.min("at").alias("at")).select("user_id", "item_id", "at.r", "at.p")
    return top_k(one, ["user_id"], [F.col("r"), F.col("p"), F.col("item_id")], n, "slot")


def constraint_search(items: DataFrame, pop: DataFrame, max_price: float, category: str, keyword: str, n: int) -> DataFrame:
    """Catalogue items under hard checks; if they are too few, those that pass price alone follow."""
    j = items.join(pop.select("item_id", "pop"), "item_id", "left").na.fill(0, ["pop"]).filter(F.col("price") <= max_price)
    strict = (F.col("category") == category) & F.contains(F.lower("title"), F.lit(keyword))
    return j.select("item_id", "category", "price", "pop", F.when(strict, 0).otherwise(1).alias("relaxed")).orderBy("relaxed", F.col("pop").desc(), "item_id").limit(n)


def discovery(items: DataFrame, seed: int, offset: int, per_category: int, n: int) -> DataFrame:
    """(category, item_id, r, slot): categories in seeded hash order, a page of each (``per_category`` items after
    ``offset``), dealt round by round into ``n`` slots."""
    order = F.md5(F.concat_ws(":", F.col("category"), F.lit(str(seed))))
    paged = items.select("category", "item_id", order.alias("h")).withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("item_id")))
    page = paged.filter((F.col("r") > offset) & (F.col("r") <= offset + per_category)).orderBy("r", "h").limit(n)
    return page.withColumn("slot", F.row_number().over(W.orderBy("r", "h"))).select("category", "item_id", "r", "slot")
