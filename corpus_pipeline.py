"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one reads from Parquet; all but the last return the
columns of ``documents``. Further columns are dropped on entry, so none can clash with a stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.llm import decontaminate, packing, pii, simhash, toxicity
from loomrec.llm.common import read_table, stored
from loomrec.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic; null and empty texts are clean."""
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"), COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of SimHash near-duplicates (4-word shingles, 4 bits) and of texts whose
    5-word shingles are 0.8 similar."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain a benchmark item."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the text and counts its characters anew; keeps every document."""
    masked = pii.mask_pii(docs, ["doc_id", "lang", "source"])
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all remaining documents in sequences of at most 4096 tokens. Workers drop their memory of pieces
    after each task, as other stages share the executors."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), remember=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
#: Fingerprints, components, tokenizers and best-fit packing are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
