"""Catalogue records for retrieval, source lines, split boundaries, and projections of session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each field of a normalised record is looked for, in this order.
FIELD_SOURCES = {
    "title": ("title_clean", "title"),
    "category": ("category",),
    "main_category": ("main_category",),
    "category_path": ("categories_path", "category_path", "categories_flat", "source_categories"),
    "description": ("description_text", "description"),
    "features": ("features_text", "features"),
    "summary": ("summary",),
    "store": ("store", "brand"),
    "average_rating": ("average_rating", "rating", "stars"),
    "rating_number": ("rating_number", "rating_count", "reviews_count"),
}
#: Labels of the parent profile, in its order.
PROFILE_LABELS = {
    "title": "Title",
    "category_path": "Category",
    "store": "Store",
    "average_rating": "Average rating",
    "rating_number": "Rating count",
    "features": "Features",
    "description": "Description",
    "summary": "Summary",
}

BLANKS = " \t\r\n"


def _text(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-empty of the columns that exist, trimmed; arrays are joined by ' > '."""
    types = dict(df.dtypes)
    have = [F.array_join(n, " > ") if types[n].startswith("array") else F.col(n).cast("string") for n in names if n in types]
    return F.coalesce(*[F.when(F.btrim(c, F.lit(BLANKS)) != "", F.btrim(c, F.lit(BLANKS))) for c in have], F.lit(None).cast("string"))


def normalise_records(items: DataFrame, key: str = "item_id") -> DataFrame:
    """The key and one text column per field; the main category falls back to the head of the path, the category to the main one."""
    flat = items.select(key, *[_text(items, names).alias(field) for field, names in FIELD_SOURCES.items()])
    flat = flat.withColumn("main_category", F.coalesce("main_category", F.trim(F.split("category_path", ">")[0])))
    return flat.withColumn("category", F.coalesce("category", "main_category"))


def _clip(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.rtrim(F.substring(text, 1, most), F.lit(BLANKS))).otherwise(text)


def compact_text(fields: list[str], most: int = 600) -> Column:
    """The distinct non-empty fields of a normalised record, joined by ' | ' and clipped."""
    return _clip(F.array_join(F.array_distinct(F.array(*fields)), " | "), most)


def profile_text(most: int = 1000) -> Column:
    """One 'Label: value' line per non-empty field of a normalised record, clipped."""
    return _clip(F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(field)) for field, label in PROFILE_LABELS.items()]), most)


def source_lines(rows: DataFrame, lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows whose source line is listed."""
    return rows.join(lines.select(column).distinct(), column, "left_semi")


def rows_at(ranked: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of a ranked table at given places (boundary, row_num)."""
    return ranked.join(places, "row_num")


def turn_projection(entries: DataFrame) -> DataFrame:
    """Entries (session_id, turn_no, seq, role): first and last seq of each turn, and the role of its last entry."""
    return entries.groupBy("session_id", "turn_no").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("role", F.struct("seq", "role")).alias("last_role"), F.count("*").alias("n_entries"))


def tool_call_projection(log: DataFrame) -> DataFrame:
    """Log (session_id, tool_call_id, status, ts, seq): the latest state of each call and when it began; blank calls are skipped."""
    known = log.filter(F.col("tool_call_id").isNotNull() & (F.trim(F.col("tool_call_id").cast("string")) != ""))
    return known.groupBy("session_id", "tool_call_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))


def append_batches(commands: DataFrame, valid: Column) -> DataFrame:
    """Commands of batches in which every command is valid; one bad command rolls its whole batch back."""
    bad = commands.filter(~F.coalesce(valid, F.lit(False))).select("batch").distinct()
    return commands.join(bad, "batch", "left_anti")


def pool_profiles(positives: DataFrame, items: DataFrame, heavy: tuple[int, int], medium: tuple[int, int]) -> DataFrame:
    """(user_id, positive_count, unique_item_count, category_count, shared_item, bucket): users with enough positives and distinct
    items are heavy if another user shares an item, else medium, else fallback only. No self-join: an item's users are counted."""
    users = positives.groupBy("item_id").agg(F.countDistinct("user_id").alias("n_users"))
    j = positives.join(users, "item_id").join(items.select("item_id", "category"), "item_id", "left")
    p = j.groupBy("user_id").agg(
        F.count("*").alias("positive_count"), F.countDistinct("item_id").alias("unique_item_count"), F.countDistinct("category").alias("category_count"),
        F.max((F.col("n_users") > 1).cast("int")).alias("shared_item"))
    enough = lambda t: (F.col("positive_count") >= t[0]) & (F.col("unique_item_count") >= t[1])
    bucket = F.when(enough(heavy) & (F.col("shared_item") == 1), "heavy").when(enough(medium), "medium").otherwise("fallback")
    return p.withColumn("bucket", bucket)
