"""Feedback log, preference projections, session and trace projections, stock and order replay: the batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrec.operators.cleaning import first_by
from loomrec.operators.streamed import in_order

CHANGING = ("LIKE", "DISLIKE", "REVERSAL")
SESSION_TTL_HOURS, PROFILE_TTL_DAYS = 24, 180


def idempotent(events: DataFrame, key: list[str]) -> DataFrame:
    """The first event of each idempotency key."""
    return first_by(events, key, F.col("ts"), F.col("event_id"))


def with_version(events: DataFrame) -> DataFrame:
    """Per profile a counter over events that change preferences; others carry the version before them."""
    changes = F.col("kind").isin(*CHANGING).cast("long")
    return events.withColumn("version", F.sum(changes).over(W.partitionBy("profile_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)))


def preferences(events: DataFrame, now: Column, ttl_days: int = PROFILE_TTL_DAYS) -> DataFrame:
    """Latest explicit preference per profile and item by version, strictly younger than the time to live."""
    e = with_version(events).filter(F.col("kind").isin("LIKE", "DISLIKE"))
    best = e.groupBy("profile_id", "item_id").agg(F.max_by(F.struct("kind", "version", "ts"), F.struct("version", "event_id")).alias("e"))
    return best.select("profile_id", "item_id", F.col("e.kind").alias("kind"), F.col("e.version").alias("version"), F.col("e.ts").alias("ts")).filter(F.col("ts") > now - F.expr(f"INTERVAL {ttl_days} DAYS"))


def reversed_preferences(events: DataFrame, reversals: DataFrame) -> DataFrame:
    """Preferences without reversed events: the previous one of an item comes back. reversals: (reverses_event_id)."""
    left = events.filter(F.col("kind").isin("LIKE", "DISLIKE")).join(reversals.select(F.col("reverses_event_id").alias("event_id")), "event_id", "left_anti")
    return left.groupBy("profile_id", "item_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("event_id").alias("last_event"))


def sessionized(events: DataFrame, gap_hours: int = SESSION_TTL_HOURS) -> DataFrame:
    """Session number per profile: a new one after more than the idle gap."""
    w = W.partitionBy("profile_id").orderBy("ts", "event_id")
    idle = F.col("ts") - F.lag("ts").over(w) > F.expr(f"INTERVAL {gap_hours} HOURS")
    return events.withColumn("session_no", F.sum(F.coalesce(idle, F.lit(True)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def session_over_profile(session: DataFrame, profile: DataFrame) -> DataFrame:
    """Session preferences win per item."""
    s = session.select("profile_id", "item_id", F.col("kind").alias("s_kind"), F.col("version").alias("s_version"))
    p = profile.select("profile_id", "item_id", F.col("kind").alias("p_kind"), F.col("version").alias("p_version"))
    j = s.join(p, ["profile_id", "item_id"], "full_outer")
    return j.select("profile_id", "item_id", F.coalesce("s_kind", "p_kind").alias("kind"), F.greatest("s_version", "p_version").alias("version"), F.when(F.col("s_kind").isNotNull(), "session").otherwise("profile").alias("scope"))


def exposure_set(delivered: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Items delivered or exposed in the last day."""
    seen = events.filter((F.col("kind") == "EXPOSURE") & (F.col("ts") > now - F.expr("INTERVAL 24 HOURS"))).select("profile_id", "item_id")
    return delivered.select("profile_id", "item_id").union(seen).distinct()


def session_activity(turns: DataFrame) -> DataFrame:
    """Per session: first and last sequence, turns per role, last role, characters."""
    return turns.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.min("turn").alias("first_seq"), F.max("turn").alias("last_seq"), F.count("*").alias("n_entries"), F.count_if(F.col("role") == "user").alias("user_entries"),
        F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


def after_checkpoint(turns: DataFrame, every: int = 3) -> DataFrame:
    """Newest checkpoint per session (each ``every``-th entry) and the entries after it."""
    marks = turns.filter((F.col("turn") + 1) % every == 0).groupBy("conv_id").agg(F.max("turn").alias("checkpoint"))
    return turns.join(marks, "conv_id", "left").filter(F.col("turn") > F.coalesce("checkpoint", F.lit(-1))).select("conv_id", "turn", "role", F.coalesce("checkpoint", F.lit(-1).cast("long")).alias("checkpoint"))


def timeline(events: DataFrame, turns: DataFrame) -> DataFrame:
    a = events.select(F.lit("event").alias("kind"), F.col("profile_id").alias("owner"), F.col("event_id").alias("seq"), F.col("kind").alias("what"))
    b = turns.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("owner"), F.col("turn").alias("seq"), F.col("role").alias("what"))
    return a.unionByName(b).withColumn("place", F.row_number().over(W.partitionBy("owner").orderBy("seq", "kind", "what")))


def phase(kind: Column) -> Column:
    return F.when(kind == "EXPOSURE", "recall").when(kind.isin("CLICK", "WHY"), "interaction").when(kind == "LIKE", "feedback").otherwise("error")


def run_monitor(events: DataFrame) -> DataFrame:
    """Per profile and phase: counts, value, failure, quality signals."""
    g = events.withColumn("phase", phase(F.col("kind"))).groupBy("profile_id", "phase").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max((F.col("kind") == "DISLIKE").cast("int")).alias("failed"), F.countDistinct("item_id").alias("n_items"))
    signals = F.array_compact(F.array(F.when(F.col("n") > 10, "busy"), F.when(F.col("total") > 1000, "slow"), F.when(F.col("failed") == 1, "failed")))
    return g.withColumn("signals", F.array_join(signals, ","))


def availability(orders_log: DataFrame) -> DataFrame:
    return orders_log.groupBy("item_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))


def guarded_stock(log: DataFrame, opening: int) -> DataFrame:
    """Replays lock requests per item in order: one that exceeds what is left is refused and takes nothing."""

    def run(rows: list[tuple]) -> list[tuple]:
        left, accepted = opening, 0
        for _, qty, _ in rows:
            if qty is not None and qty <= left:
                left -= qty
                accepted += 1
        return [(rows[0][0], left, accepted, len(rows) - accepted)]

    return in_order(log.select("item_id", "qty", "ord"), "item_id", [F.col("ord").asc_nulls_last()], run, "item_id long, available long, accepted long, refused long")


def coupon_matches(orders: DataFrame, coupons: DataFrame) -> DataFrame:
    """Orders inside a coupon's half-open window and above its threshold; coupons share the segment key."""
    return orders.join(coupons, "segment").filter((F.col("ts") >= F.col("starts")) & (F.col("ts") < F.col("ends")) & (F.col("amount") >= F.col("least")))


def task_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "P").alias("in_review"))
