"""Queries over the driver's tables for the training-data operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import documents, fresh_name


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from glyphmill.llm import bpe

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import sharding

    return sharding.shard(documents(spark, sf_dir), shards=16)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import simhash

    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import lm_score

    return lm_score.pseudo_likelihood(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import exact_dedup

    docs, index = documents(spark, sf_dir), exact_dedup.DigestIndex(spark, fresh_name("digest_index"))
    out = exact_dedup.deduplicate(docs, index)
    index.drop()  # the result is read from checkpoints
    return out


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import secrets

    return secrets.scan(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, and its path within the host its language."""
    from glyphmill.llm import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.posterior(documents(spark, sf_dir), labels, F.col("source"), F.col("lang"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import toxicity

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    out = toxicity.score(docs, model, threshold=0.7)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import decontam

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.search(documents(spark, sf_dir), items, threshold=0.8, shingle=5)


OP9_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
its AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles
"""

def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm import substring_dedup

    return substring_dedup.remove_repeats(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ring_shards": op2_ring_shards,
    "op3_simhash": op3_simhash,
    "op4_lm_score": op4_lm_score,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_repeats": op10_repeats,
}

ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op9_decontamination": OP9_SQL}
