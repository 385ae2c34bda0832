"""Scores records against described intents: saturated field counts, phrases by adjacency of positions, categories, negations.

Postings carry the position of each token in the record's whole text, the fields joined in order. A phrase of m tokens stands where the
postings of its tokens agree on one start, so phrases cost a join on tokens and a count, and no text is read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.operators.classes import best_members, class_heads
from loomrec.operators.posting_segments import bucket_of
from loomrec.operators.tables import drop_stored, stored
from loomrec.sources.manifests import commit_manifest, new_folder, read_manifest, write_dealt

# Tokens that say nothing about an item.
GENERIC = "and the with for from item product products a an of to in on by or set pack".split()
# Points of a phrase in the title, or elsewhere; of what is missing; of a category; of a negated phrase.
INTENT_TITLE, INTENT_BODY = 60, 25
CORE_TITLE, CORE_BODY, CORE_MISSING, CORE_NOT_IN_TITLE = 28, 5, -90, -55
CATEGORY, CATEGORY_MISSING = 45, -20
NEGATIVE_TITLE, NEGATIVE_BODY = -120, -80
REQUIRED_MISSING = -120
CORE_WEIGHT, SATURATION = 3.0, 1.2

KINDS = ("description", "core", "must", "any", "intent", "category", "negative")
POSITIONS = "doc long, field int, token string, pos int, part int, bucket int"
BUCKETS, BLOCK_ROWS = 256, 2_000_000


@dataclass(frozen=True)
class Field:
    """A scored column, in text order. part: title, category or body; fields of one part stand side by side."""

    column: str
    weight: float
    part: str


def terms(value: Column) -> Column:
    """Lower-cased runs of A-Z, a-z, 0-9 of two characters or more that aren't generic; none for null."""
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: (F.length(t) > 1) & ~t.isin(GENERIC))


def positional_postings(records: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """(doc, field, token, pos): field is the number of the column, pos the token's place in all fields joined in order. A column may be a
    string or an array of strings. Rows without a key are left out; rows that share one would mix: the caller dedups."""
    text = lambda c: F.concat_ws(" ", c) if records.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    numbered = lambda n, c: F.transform(terms(text(c)), lambda t: F.struct(F.lit(n).alias("field"), t.alias("token")))
    parts = [numbered(n, f.column) for n, f in enumerate(fields)]
    rows = records.select(F.col(key).cast("long").alias("doc"), F.flatten(F.array(*parts)).alias("t")).filter("doc is not null")
    return rows.select("doc", F.posexplode("t").alias("pos", "t")).select("doc", "t.field", "t.token", "pos")


def store_positions(positions: DataFrame, root: str, n_docs: int, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> int:
    """Stores postings by token bucket as a new version under ``root``, with the number of records for the token weights."""
    spark = positions.sparkSession
    after, _ = read_manifest(spark, root)
    placed = stored(positions.withColumn("bucket", bucket_of("token", buckets)), "positions")
    folder = new_folder("positions")
    write_dealt(placed, f"{root}/{folder}", "bucket", "doc", block_rows, ["token", "doc", "pos"])
    drop_stored(placed)
    return commit_manifest(spark, root, after, {"positions": folder, "buckets": buckets, "n_docs": n_docs})


def stored_positions(spark: SparkSession, root: str, intents: DataFrame) -> tuple[DataFrame, int]:
    """The postings in the buckets that the intents' tokens need, and the number of records."""
    _, content = read_manifest(spark, root)
    tokens = intents.select(F.explode(terms(F.col("phrase"))).alias("token"))
    wanted = [r["b"] for r in tokens.select(bucket_of("token", content["buckets"]).alias("b")).distinct().collect()]  # at most the buckets
    return spark.read.schema(POSITIONS).parquet(f"{root}/{content['positions']}").filter(F.col("bucket").isin(wanted)).select("doc", "field", "token", "pos"), content["n_docs"]


def _micro(x: Column) -> Column:
    """Millionths, so that a sum doesn't depend on its order."""
    return F.round(x * 1_000_000).cast("long")


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def phrase_hits(positions: DataFrame, phrases: DataFrame, fields: list[Field]) -> DataFrame:
    """(query, phrase_no, doc, in_title, in_category) of every phrase that stands in a record's text, wherever it stands.

    phrases: (query, phrase_no, tokens). in_title, in_category: some occurrence lies in such fields alone.
    """
    numbers = lambda part: [n for n, f in enumerate(fields) if f.part == part]
    words = phrases.select("query", "phrase_no", F.size("tokens").alias("m"), F.posexplode("tokens").alias("at", "token"))
    met = positions.join(words, "token").groupBy("query", "phrase_no", "doc", (F.col("pos") - F.col("at")).alias("start"), "m")
    stands = met.agg(F.count("*").alias("n"), F.min(F.col("field").isin(numbers("title"))).alias("title"), F.min(F.col("field").isin(numbers("category"))).alias("cat")).filter("n = m")
    return stands.groupBy("query", "phrase_no", "doc").agg(F.max("title").alias("in_title"), F.max("cat").alias("in_category"))


def score_intents(positions: DataFrame, intents: DataFrame, fields: list[Field], n_docs: int, k: int) -> DataFrame:
    """(query, doc, score, field_score, required_pass, strict_pass, rank): the k best records of every intent.

    intents: (query, kind, grp, phrase), a row per phrase; kinds are KINDS, grp tells the groups of kind ``any`` apart, of each of which
    one phrase must stand in the record. Every kind's tokens ask; those of ``core`` weigh CORE_WEIGHT times. Records without any of an
    intent's tokens aren't scored. A phrase without tokens never stands. A repeated phrase counts as often as it occurs. Field
    scores are summed in millionths. Ties go to the smaller record.

    Records with the same asked tokens in the same places are one class, and so are intents with the same phrases: scores are taken
    between classes, and every distinct phrase is looked for once.
    """
    unknown = ~F.col("kind").isin(*KINDS)
    told = intents.select("query", F.when(unknown, F.raise_error(F.concat(F.lit("unknown kind "), "kind"))).otherwise(F.col("kind")).alias("kind"), "grp", terms(F.col("phrase")).alias("tokens"))
    # equal rows are told apart by a number per intent; an intent is a handful of phrases
    listed = told.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("kind", "grp", "tokens"))).alias("all"))
    listed = stored(listed, "intents")
    alike = stored(listed.groupBy("all").agg(F.min("query").alias("like")), "alike-intents")
    phrases = stored(alike.select(F.col("like").alias("query"), F.posexplode("all").alias("phrase_no", "p")).select("query", "phrase_no", "p.*"), "phrases")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    needs = phrases.groupBy("query").agg(count("core").alias("n_core"), count("must").alias("n_must"), F.count_distinct(F.when(F.col("kind") == "any", F.coalesce("grp", F.lit(0)))).alias("n_any"), (count("category") > 0).alias("has_category"))

    asked = phrases.select("query", F.explode("tokens").alias("token"), F.when(F.col("kind") == "core", CORE_WEIGHT).otherwise(1.0).alias("role")).groupBy("query", "token").agg(F.max("role").alias("role"))
    wanted = positions.join(asked.select("token").distinct(), "token", "left_semi")
    texts = stored(wanted.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "field", "token"))).alias("text")), "wanted")
    heads = stored(class_heads(texts, ["text"], "doc", k), "record-classes")
    wanted = heads.select(F.col("first").alias("doc"), "n", F.explode("text").alias("t")).select("doc", "n", "t.*")
    tf = wanted.groupBy("doc", "n", "field", "token").agg(F.count("*").alias("tf"))
    df = tf.select("doc", "n", "token").distinct().groupBy("token").agg(F.sum("n").alias("df"))
    weight = reduce(lambda acc, f: acc.when(F.col("field") == f[0], f[1].weight), enumerate(fields), F.when(F.lit(False), 0.0))
    part = F.col("role") * F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (F.col("tf") * (1 + SATURATION) / (F.col("tf") + SATURATION)) * weight
    field = tf.join(df, "token").join(asked, "token").groupBy("query", "doc").agg((F.sum(_micro(part)) / 1_000_000).alias("field_score"))

    kind, title, cat = F.col("kind"), F.col("in_title"), F.col("in_category")
    points = F.when(kind == "intent", F.when(title, INTENT_TITLE).otherwise(INTENT_BODY)).when(
        kind == "core", F.when(title, CORE_TITLE - CORE_MISSING - CORE_NOT_IN_TITLE).otherwise(CORE_BODY - CORE_MISSING)
    ).when(kind == "negative", F.when(title, NEGATIVE_TITLE).otherwise(NEGATIVE_BODY)).otherwise(0)
    lasting = phrases.filter("kind <> 'description' and size(tokens) > 0")
    spoken = lasting.groupBy("tokens").agg(F.min(F.struct("query", "phrase_no")).alias("p")).select("p.*", "tokens")
    stand = spoken.join(phrase_hits(wanted, spoken, fields), ["query", "phrase_no"]).drop("query", "phrase_no")
    hits = lasting.join(stand, "tokens").drop("tokens")
    met = hits.groupBy("query", "doc").agg(
        F.sum(points).alias("points"), count("must").alias("must_met"), F.count_distinct(F.when(kind == "any", F.coalesce("grp", F.lit(0)))).alias("any_met"),
        _any((kind == "category") & cat).alias("category_met"), _any(kind == "negative").alias("negated"),
    )
    j = field.join(met, ["query", "doc"], "left").join(needs, "query")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    in_category, negated = F.coalesce("category_met", F.lit(False)), F.coalesce("negated", F.lit(False))
    required = (zero("must_met") == F.col("n_must")) & (zero("any_met") == F.col("n_any"))
    extra = zero("points") + F.col("n_core") * (CORE_MISSING + CORE_NOT_IN_TITLE) + F.when(in_category, CATEGORY).when(F.col("has_category"), CATEGORY_MISSING).otherwise(0) + F.when(required, 0).otherwise(REQUIRED_MISSING)
    strict = required & ~negated & (in_category | ~F.col("has_category"))
    scored = j.select("query", F.col("doc").alias("first"), F.round(F.col("field_score") + extra, 6).alias("score"), "field_score", required.alias("required_pass"), strict.alias("strict_pass"))
    best = best_members(scored, heads, ["query"], "doc", k).withColumnRenamed("query", "like")
    return listed.join(alike, "all").join(best, "like").select("query", "doc", "score", "field_score", "required_pass", "strict_pass", "rank")
