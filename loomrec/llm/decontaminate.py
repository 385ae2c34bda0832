"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item with q distinct shingles is contained in a document that holds at least ceil(0.8 q) of them, so at most
m = q - ceil(0.8 q) are missing and one of ANY m + 1 of its shingles is present. The item's signature is its m + 1 smallest
shingle hashes: probing documents for these alone loses no document, however long it is. Items are partitioned by size;
each partition has its own hash ceiling (its largest signature value) and least document size. Built-ins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import ascii_lower, let, stored, words_of

SHINGLE_WORDS, CONTAINMENT = 5, 0.8
#: A side is broadcast only if it has been counted and has at most this many rows (of some 24 bytes); else it is shuffled.
BROADCAST_ROWS = 1_000_000


def _need(q: Column) -> Column:
    """ceil(0.8 q) in whole numbers."""
    return ((q * 4 + 4) / 5).cast("long")


def window_hashes(words: Column, width: int) -> Column:
    """64-bit hash of every ``width`` consecutive words, chained word by word."""
    several = F.transform(F.slice(words, 1, F.size(words) - width + 1), lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)]))
    return F.when(F.size(words) >= width, several).otherwise(F.array().cast("array<bigint>"))


def window_texts(words: Column, width: int) -> Column:
    several = F.transform(F.slice(words, 1, F.size(words) - width + 1), lambda x, i: F.array_join(F.slice(words, i + 1, width), " "))
    return F.when(F.size(words) >= width, several).otherwise(F.array().cast("array<string>"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_table(items: DataFrame, widths: list[int]) -> DataFrame:
    """(item_id, width, shingles, hashes, q, need): one row per item with words; items shorter than a shingle are one
    shingle of their own width. Items that repeat an id each count by themselves."""
    w = items.select("item_id", words_of(ascii_lower(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(SHINGLE_WORDS))
    shingles, hashes = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    for n in widths:
        shingles = F.when(F.col("width") == n, F.array_distinct(window_texts(F.col("w"), n))).otherwise(shingles)
        hashes = F.when(F.col("width") == n, F.array_distinct(window_hashes(F.col("w"), n))).otherwise(hashes)
    out = w.withColumn("width", width).select("item_id", "width", shingles.alias("shingles"), hashes.alias("hashes"))
    out = out.withColumn("q", F.size("shingles").cast("long")).withColumn("need", _need(F.col("q")))
    return out.withColumn("item_key", F.xxhash64("item_id", F.array_join("shingles", "\n")))


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that holds at least 0.8 of an item's distinct
    5-word shingles (lower-cased A-Z, words split at white space).

    The probe explodes shingle hashes below the ceilings and joins them with the signatures; only candidate documents are
    read again and compared shingle by shingle. Null or empty texts hold and are nothing; rows with equal ids and texts
    give one pair; no items or no documents give no rows. A passage in many documents costs one candidate row for each.
    """
    present = items.select(F.least(F.size(words_of(F.col("text"))), F.lit(SHINGLE_WORDS)).alias("n")).filter("n > 0").distinct()
    widths = sorted(r["n"] for r in present.collect())  # at most SHINGLE_WORDS values
    table = stored(item_table(items, widths), "items")
    signature = table.select(
        "item_key", "width", "need", F.log2("q").cast("int").alias("size_class"),
        F.explode(F.slice(F.sort_array("hashes"), 1, (F.col("q") - F.col("need") + 1).cast("int"))).alias("h"),
    )
    limits = signature.groupBy("width", "size_class").agg(F.max("h").alias("ceiling"), F.min("need").alias("least"), F.count("*").alias("n")).collect()

    def probes(w: Column) -> Column:
        parts = [F.array().cast("array<bigint>")]
        for width in widths:
            of_width = [r for r in limits if r["width"] == width]
            ceiling = F.lit(-(2**63))
            for r in of_width:  # the highest ceiling among the size partitions that this document can hold
                ceiling = F.greatest(ceiling, F.when(F.size(w) - width + 1 >= r["least"], F.lit(r["ceiling"])).otherwise(F.lit(-(2**63))))
            hashes = window_hashes(w, width)
            parts.append(let(ceiling, lambda c: F.filter(hashes, lambda h: h <= c)))  # noqa: B023
        return F.concat(*parts)

    n_signature = sum(r["n"] for r in limits)
    text_key = F.xxhash64("text")
    probed = docs.select("doc_id", text_key.alias("text_key"), F.explode(let(words_of(ascii_lower(F.col("text"))), probes)).alias("h"))
    small = _bounded(signature.select("h", "item_key"), n_signature)
    pairs = stored(probed.join(small, "h").select("doc_id", "text_key", "item_key").distinct(), "candidates")
    wanted = pairs.groupBy("doc_id", "text_key").agg(F.collect_set("item_key").alias("item_keys"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "item_keys")
    found = docs.select("doc_id", "text", text_key.alias("text_key")).join(
        _bounded(wanted, pairs.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    )
    held = found.dropDuplicates(["doc_id", "text_key"]).withColumn("w", words_of(ascii_lower(F.col("text"))))
    texts = F.concat(F.array().cast("array<string>"), *[window_texts(F.col("w"), n) for n in widths])
    opened = held.select("doc_id", F.array_distinct(texts).alias("own"), F.explode("item_keys").alias("item_key"))
    checked = opened.join(_bounded(table.select("item_key", "item_id", "shingles", "q", "need"), n_signature), "item_key")
    shared = checked.withColumn("n_shared", F.size(F.array_intersect("own", "shingles")).cast("long"))
    return shared.filter("n_shared >= need").select(
        "doc_id", "item_id", F.col("q").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment")
    ).distinct()


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; a row with a null id stays unless it contains one."""
    hit = contained_items(docs, items).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_anti")
