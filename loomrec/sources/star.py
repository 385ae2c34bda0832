"""Engine tables derived from the star schema: interactions, items, feedback events, chunks, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.operators import cleaning
from loomrec.operators.tables import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, ts in ms, rating 1 to 5, verified, helpful, ord); ord is the ingest ordinal that breaks ties."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        (1 + F.col("l_quantity").cast("long") % 5).alias("rating"), (F.col("l_returnflag") == "N").alias("verified"),
        F.col("l_linenumber").cast("long").alias("helpful"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical interactions: exact duplicates out, the last of each user and item, ordinal time split, labels. A query stores them
    once, and so their rows before the split, which are counted, dealt by hour and numbered."""

    def build() -> DataFrame:
        latest = once(("latest", sf_dir), lambda: cleaning.latest_exact(raw_interactions(spark, sf_dir)))
        return cleaning.with_labels(cleaning.ordinal_split(latest))

    return once(("interactions", sf_dir), build)


def train_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).filter("split = 'train' and label_binary = 1")


def recent_positives(spark: SparkSession, sf_dir: str, last: int = 50) -> DataFrame:
    """(user_id, item_id, row_num, pos, len, strong): each user's last positives, pos from 1 in time order."""
    return once(("positives", sf_dir, last), lambda: cleaning.recent_events(train_positives(spark, sf_dir), last))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.concat(F.array("p_type"), F.split("p_name", " ")).alias("categories"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in {"view": "EXPOSURE", "click": "CLICK", "purchase": "LIKE", "error": "DISLIKE", "signup": "WHY"}.items() for x in kv])
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("profile_id"), kind[F.col("event_type")].alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"), "value",
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, broken ones become nulls."""
    return spark.read.schema(schema).json(path)
