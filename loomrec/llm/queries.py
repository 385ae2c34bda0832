"""Queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomrec.llm import class_lm, decontaminate, encoding, imatch, packing, pages, periodic, pii, quality, sharding, simhash, toxicity, yinyang
from loomrec.llm.common import read_table


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read_table(spark, sf_dir, "documents"))


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first_clean(read_table(spark, sf_dir, "documents"), ["doc_id"]).drop("clean_text")


def op10_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_ranked_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.ranked_id_digest(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(read_table(spark, sf_dir, "documents"))


def op4_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_minhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(read_table(spark, sf_dir, "documents"))


def op5_nearest_url_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(read_table(spark, sf_dir, "pages"))


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster_digest(read_table(spark, sf_dir, "embeddings"))


def op12_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_digest(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_brown_class_bigrams": op2_brown_class_bigrams,
    "op3_ranked_token_ids": op3_ranked_token_ids,
    "op4_weak_supervision_toxicity": op4_weak_supervision_toxicity,
    "op5_nearest_url_main_text": op5_nearest_url_main_text,
    "op6_residual_packing": op6_residual_packing,
    "op7_line_first_quality": op7_line_first_quality,
    "op8_deletion_variant_simhash": op8_deletion_variant_simhash,
    "op9_minhash_decontamination": op9_minhash_decontamination,
    "op10_pii_checksums": op10_pii_checksums,
    "op11_yinyang_clusters": op11_yinyang_clusters,
    "op12_imatch_fingerprints": op12_imatch_fingerprints,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}


def kmeans_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """Plain rounds of exact integer k-means, one pair of common tables a round."""
    parts = [
        f"""q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v m FROM q ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, c := c)) b FROM (
SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT d FROM q, c{r}) GROUP BY vec_id, v)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) m FROM (SELECT b.c c, i, sum(v[i])::DOUBLE s, count(*) n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s{r}.m, c{r}.m) m FROM c{r} LEFT JOIN s{r} USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, b.c::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT cluster_inertia, (sum(b.d) OVER ())::BIGINT inertia, sha256(array_to_string(m, ',')) centroid_sha256
FROM a{rounds} JOIN c{rounds} ON b.c = c"""


WORDS_SQL = "list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '')"
#: Operators whose whole result SQL can express; items here have five words or more.
ORACLE_SQL: dict[str, str] = {
    "op9_minhash_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format(t="text")} w FROM documents), b AS (SELECT item_id, {WORDS_SQL.format(t="text")} w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) i FROM b)),
q AS (SELECT item_id, count(*) n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, n_item, count(*) n_shared, count(*) / n_item containment FROM ds JOIN bs USING (s) JOIN q USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 5 >= n_item * 4""",
    "op11_yinyang_clusters": kmeans_sql(),
}
