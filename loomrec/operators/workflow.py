"""Commerce and delivery state: version guards, outbox, leases, state guards, invariants, coupons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apply_newer(stored: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Stored rows after updates: an update counts only if its version is above the stored one; the newest wins."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.col(version).desc(), "__new")
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").withColumnRenamed("__new", "updated")


def current_events(events: DataFrame, keys: list[str], after: int = 0, page: int | None = None) -> DataFrame:
    """Latest event per key; with ``page``, the next rows after an event id (keyset page, the limit is the feature)."""
    last = events.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("event_id").desc()))).filter("r = 1").drop("r")
    return last if page is None else last.filter(F.col("event_id") > after).orderBy("event_id").limit(page)


def backoff_seconds(attempts: Column) -> Column:
    """2^n seconds, at most 300."""
    return F.least(F.lit(300), F.pow(F.lit(2), F.least(attempts, F.lit(20))).cast("long")).cast("long")


def outbox_due(events: DataFrame, now: Column) -> DataFrame:
    """Pending events whose wait is over; ``events`` (event_id, created, attempts, done)."""
    due = F.col("created") + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))
    return events.filter(~F.col("done")).withColumn("wait", backoff_seconds(F.col("attempts"))).filter(due <= now)


def leases_due(tasks: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Pending tasks that are due and tasks in work whose lease has run out, oldest first, ``limit`` at a time."""
    ready = ((F.col("state") == "PENDING") & (F.col("due") <= now)) | ((F.col("state") == "PROCESSING") & (F.col("lease_until") < now))
    return tasks.filter(ready).orderBy("due", "task_id").limit(limit)


def consumed_once(messages: DataFrame) -> DataFrame:
    """First delivery of each message to each consumer, with the number of deliveries."""
    return messages.groupBy("message_id", "consumer").agg(F.min("delivery").alias("delivery"), F.count("*").alias("deliveries"))


def guarded_transition(rows: DataFrame, state: str, wanted: Column, allowed_from: str) -> DataFrame:
    """State after a request: it changes only from ``allowed_from``; ``applied`` tells whether it did."""
    applied = (F.col(state) == allowed_from) & wanted.isNotNull()
    return rows.withColumn("applied", F.coalesce(applied, F.lit(False)).cast("int")).withColumn("state_after", F.when(F.col("applied") == 1, wanted).otherwise(F.col(state)))


def paid_matches(orders: DataFrame, payments: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Orders whose payments have the order's amount, provider and a paid status; one row per order."""
    p = payments.groupBy("order_id").agg(F.round(F.sum("amount"), 2).alias("paid"), F.min(F.col("settled").cast("int")).alias("all_settled"))
    ok = (F.abs(F.col("paid") - F.col("amount")) <= tolerance) & (F.col("all_settled") == 1)
    return orders.join(p, "order_id", "left").withColumn("accepted", F.coalesce(ok, F.lit(False)).cast("int"))


def pool_balance(log: DataFrame) -> DataFrame:
    """Per pool the total and its parts, and whether total = available + reserved + sold + returned."""
    part = lambda s: F.sum(F.when(F.col("state") == s, F.col("qty")).otherwise(0)).alias(s)
    states = ["available", "reserved", "sold", "returned"]
    sums = log.groupBy("pool").agg(F.sum("qty").alias("total"), *[part(s) for s in states])
    return sums.withColumn("balanced", (F.col("total") == sum((F.col(s) for s in states[1:]), F.col(states[0]))).cast("int"))
