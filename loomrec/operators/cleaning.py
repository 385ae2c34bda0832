"""Cleaning, deduplication, splits, sequences, quality profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def clean_text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def flat_list(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), " ")


def length_bucket(n: Column) -> Column:
    """Labelled range of a text length."""
    return F.when(n == 0, "0").when(n <= 200, "1-200").when(n <= 1000, "201-1000").when(n <= 5000, "1001-5000").otherwise("5001+")


def item_text(items: DataFrame) -> DataFrame:
    """Title, category path and brand on a line each, blanks left out."""
    lines = F.filter(F.array(clean_text(F.col("title")), flat_list(F.col("categories")), clean_text(F.col("brand"))), lambda x: x != "")
    return items.select("item_id", F.array_join(lines, "\n").alias("item_text"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def exact_dedup(df: DataFrame) -> DataFrame:
    return first_by(df, ["user_id", "item_id", "ts"], F.col("ord"))


def keep_last(df: DataFrame) -> DataFrame:
    return first_by(df, ["user_id", "item_id"], F.col("ts").desc(), F.col("ord").desc())


def latest_exact(df: DataFrame) -> DataFrame:
    """``keep_last`` of ``exact_dedup`` in one pass: of a user and item the newest rows, of those the first one ingested."""
    return first_by(df, ["user_id", "item_id"], F.col("ts").desc(), F.col("ord"))


def global_rank(df: DataFrame, ts: str, ties: list[str], name: str = "row_num") -> DataFrame:
    """Rank over the whole table by (ts, ties) without one task for all rows: hours get offsets from their counts, rows
    are numbered inside their hour."""
    hourly = df.withColumn("__hour", F.floor(F.col(ts) / HOUR_MS))
    counts = hourly.groupBy("__hour").count()
    before = W.orderBy("__hour").rowsBetween(W.unboundedPreceding, -1)  # one row per hour of the table's span
    offsets = counts.select("__hour", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__hour").orderBy(ts, *ties))
    return hourly.withColumn("__own", own).join(offsets, "__hour").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__hour", "__before", "__own")


def split_sizes(n: int, valid: float = 0.1, test: float = 0.1, all_train_upto: int = 0) -> tuple[int, int, int]:
    """(train, valid, test) of n rows: tiny tables are all train, larger ones give each part a row at least."""
    if n <= 2 or n <= all_train_upto:
        return n, 0, 0
    v, t = max(1, int(n * valid)), max(1, int(n * test))
    if n - v - t > 0:
        return n - v - t, v, t
    rest = max(1, n - 2)
    return rest, 1, n - rest - 1


def ordinal_split(df: DataFrame, valid: float = 0.1, test: float = 0.1) -> DataFrame:
    ranked = global_rank(df, "ts", ["user_id", "item_id"])
    train, v, _ = split_sizes(df.count(), valid, test)
    return ranked.withColumn("split", F.when(F.col("row_num") <= train, "train").when(F.col("row_num") <= train + v, "valid").otherwise("test"))


def with_labels(df: DataFrame, threshold: float = 4.0) -> DataFrame:
    positive = F.coalesce(F.col("rating") >= threshold, F.lit(False))
    strength = F.round(F.coalesce(F.col("rating"), F.lit(0)) / 5, 4) + F.when(F.col("verified"), 0.2).otherwise(0.0) + F.least(F.col("helpful"), F.lit(10)) / 50
    return df.withColumns({
        "label_binary": positive.cast("int"), "label_strong": (positive & F.col("verified")).cast("int"), "label_strength": F.round(strength, 6),
    })


def k_core(df: DataFrame, min_user: int, min_item: int, max_rounds: int = 50) -> DataFrame:
    """Removes users and items with too few interactions until none is left; each round is a checkpoint, so the plan of a
    late round doesn't hold the early ones."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="loomrec-"))
    current, before = df.checkpoint(), -1
    for _ in range(max_rounds):
        n = current.count()
        if n == before:
            return current
        before = n
        users = current.groupBy("user_id").count().filter(F.col("count") < min_user).select("user_id")
        rare = current.groupBy("item_id").count().filter(F.col("count") < min_item).select("item_id")
        current = current.join(users, "user_id", "left_anti").join(rare, "item_id", "left_anti").checkpoint()
    raise RuntimeError("k-core did not settle")


def split_summary(df: DataFrame) -> DataFrame:
    return df.rollup("split").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items")).select(
        F.coalesce("split", F.lit("all")).alias("split"), "n_rows", "n_users", "n_items"
    )


def train_readiness(df: DataFrame) -> DataFrame:
    """Positive rows, users with positives, and users with two distinct positive items or more."""
    users = df.filter("split = 'train' and label_binary = 1").groupBy("user_id").agg(F.countDistinct("item_id").alias("d"), F.count("*").alias("n"))
    return users.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("positive_rows"), F.count("*").alias("positive_users"), F.count_if(F.col("d") >= 2).alias("ready_users"))


def calendar_split(ts: Column, train_end: int, valid_end: int, test_end: int, start: int = 0) -> Column:
    """Half-open windows; outside all of them: null."""
    return F.when((ts >= start) & (ts < train_end), "train").when((ts >= train_end) & (ts < valid_end), "valid").when((ts >= valid_end) & (ts < test_end), "test")


def coverage_bits(df: DataFrame, key: str) -> DataFrame:
    """Per key the splits it is seen in: 1 train, 2 valid, 4 test."""
    bit = F.when(F.col("split") == "train", 1).when(F.col("split") == "valid", 2).otherwise(4)
    return df.groupBy(key).agg(F.bit_or(bit).alias("bits"))


def recent_events(df: DataFrame, last: int) -> DataFrame:
    newest = W.partitionBy("user_id").orderBy(F.col("row_num").desc())
    kept = df.withColumn("__back", F.row_number().over(newest)).filter(F.col("__back") <= last)
    n = F.count("*").over(W.partitionBy("user_id"))
    return kept.withColumn("len", n.cast("int")).select("user_id", "item_id", "row_num", (F.col("len") - F.col("__back") + 1).alias("pos"), "len", F.col("label_strong").alias("strong"))


def user_sequences(df: DataFrame, last: int = 50) -> DataFrame:
    """Counters and the last items of each user in time order: all, positive, strong positive."""

    def tail(flag: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(flag, F.struct("row_num", "item_id"))))
        return F.transform(F.slice(rows, F.greatest(F.lit(1), F.size(rows) - last + 1), last), lambda x: x["item_id"])

    positive, strong = F.col("label_binary") == 1, F.col("label_strong") == 1
    return df.groupBy("user_id").agg(
        F.count("*").alias("sequence_len"), F.count_if(positive).alias("positive_len"), F.count_if(strong).alias("strong_len"),
        tail(F.lit(True)).alias("recent_items"), tail(positive).alias("recent_positive_items"), tail(strong).alias("recent_strong_items"),
    )


def leave_one_out(sequences: DataFrame) -> DataFrame:
    """Last positive of users with two or more, and the rest of their sequence without it."""
    some = sequences.filter(F.size("recent_positive_items") >= 2).withColumn("held_out", F.element_at("recent_positive_items", -1))
    return some.select("user_id", "held_out", F.array_remove("recent_items", F.col("held_out")).alias("rest"))


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Commonest value per key; ties go to the smallest."""
    counts = df.groupBy(key, value).count()
    return first_by(counts, [key], F.col("count").desc(), F.col(value)).select(key, F.col(value).alias(f"modal_{value}"))


def item_quality(train: DataFrame, items: DataFrame) -> DataFrame:
    """Frequencies, global and per-category popularity rank, hotness and quality bucket of every item."""
    stats = train.groupBy("item_id").agg(F.count("*").alias("events"), F.count_if(F.col("label_binary") == 1).alias("positives"), F.countDistinct(F.when(F.col("label_binary") == 1, F.col("user_id"))).alias("positive_users"))
    j = items.select("item_id", "category", (F.length("title") > 0).alias("text_ready")).join(stats, "item_id", "left").na.fill(0, ["events", "positives", "positive_users"])
    order = (F.col("positives").desc(), F.col("item_id"))
    hot = F.when(F.col("positives") == 0, "none").when(F.col("positives") < 5, "long_tail").when(F.col("positives") < 15, "mid").otherwise("hot")
    quality = F.when(~F.col("text_ready"), "no_text").when(F.col("positive_users") >= 10, "strong").when(F.col("positive_users") >= 3, "usable").when(F.col("positives") > 0, "sparse").otherwise("cold")
    # numbering inside a category keeps one task per category; the global rank is a count per popularity value plus a rank
    by_value = j.groupBy("positives").count()
    above = by_value.select("positives", F.coalesce(F.sum("count").over(W.orderBy(F.col("positives").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    j = j.withColumn("within", F.row_number().over(W.partitionBy("positives").orderBy("item_id"))).join(above, "positives")
    return j.withColumn("category_rank", F.row_number().over(W.partitionBy("category").orderBy(*order))).select(
        "item_id", "category", "events", "positives", "positive_users", (F.col("above") + F.col("within")).cast("long").alias("global_rank"), "category_rank", hot.alias("hotness"), quality.alias("quality")
    )


def user_quality(train: DataFrame) -> DataFrame:
    """Bucket per user by the first rule that holds, with the mean popularity of its items."""
    pop = train.groupBy("item_id").agg(F.countDistinct("user_id").alias("item_users"))
    agg = train.join(pop, "item_id").groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("label_binary") == 1).alias("positives"), F.max("item_users").alias("max_item_users"), F.round(F.avg("item_users"), 6).alias("avg_item_users"))
    rule = F.when(F.col("positives") >= 20, "heavy").when(F.col("positives") >= 10, "two_tower").when(F.col("positives") >= 5, "medium").when(F.col("positives") >= 1, "cold").otherwise("fallback")
    return agg.select("*", (F.col("max_item_users") > 1).cast("int").alias("shares_items"), rule.alias("bucket"))


def universe_coverage(train: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Share of interactions that items of each minimum frequency cover."""
    freq = train.groupBy("item_id").agg(F.count("*").alias("f"))
    cuts = F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("min_freq")
    return freq.select("f", cuts).groupBy("min_freq").agg(
        F.count_if(F.col("f") >= F.col("min_freq")).alias("n_items"), F.round(F.sum(F.when(F.col("f") >= F.col("min_freq"), F.col("f")).otherwise(0)) / F.sum("f"), 6).alias("coverage"))


def activity_segments(df: DataFrame, ratios: tuple[float, float] = (0.2, 0.5)) -> DataFrame:
    """Users by falling history, cut at floor(n * ratio): hot, warm, cold. Ranks come from counts per history length."""
    users = df.groupBy("user_id").agg(F.count("*").alias("history"))
    lengths = users.groupBy("history").count()
    all_before = F.coalesce(F.sum("count").over(W.orderBy(F.col("history").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("count").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = lengths.select("history", all_before.alias("before"), total.alias("n"))
    ranked = users.withColumn("own", F.row_number().over(W.partitionBy("history").orderBy("user_id"))).join(offsets, "history")
    rank = F.col("before") + F.col("own")
    hot, warm = F.floor(F.col("n") * ratios[0]), F.floor(F.col("n") * ratios[1])
    return ranked.select("user_id", "history", F.when(rank <= hot, "hot").when(rank <= warm, "warm").otherwise("cold").alias("segment"))


def stratified_sample(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """A fixed number per stratum in the order of a seeded hash."""
    order = W.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= quota[F.col(stratum)]).drop("__n")


def largest_remainder(weights: dict[str, float], total: int) -> dict[str, int]:
    s = sum(weights.values())
    exact = {k: total * w / s for k, w in weights.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out
