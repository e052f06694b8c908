"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_recipes import exact_duplicates
from .common import table
from .hard_negatives import hard_negatives
from .lexical_search import ranked
from .ogg import media_features, with_media
from .order_minhash import near_duplicates
from .packing import packed
from .piece_bpe import piece_digests
from .range_join import near_vectors
from .secrets import labelled_samples, report_sql, secret_report, train
from .sharding import record_size, write_shards
from .token_counts import token_counts
from .token_files import token_digests, write_token_files
from .toxicity import fit, held_out, with_scores

END_ID = 2
SHARDS = 40


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = with_media(table(spark, sf_dir, "documents"))
    return media_features(media, keep=("doc_id", "n_bytes")).drop("error")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_digests(spark, files)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"), train(labelled_samples()))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), SHARDS)
    return shards.select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op12_ball_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(vectors, F.col("id") % 100 == 0)


def op13_cluster_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_ogg_media, op3_order_minhash, op4_token_files, op5_secrets, op6_packing, op7_sharding, op8_range_join, op9_toxicity, op10_piece_bpe, op11_chunk_recipes, op12_ball_negatives, op13_cluster_search)
    return {f.__name__: f for f in ops}


RANGE_JOIN_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
), parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN counts USING (vec_id)"""


DUPLICATES_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(t) AS text_sha256
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
  WINDOW same AS (PARTITION BY t))"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN met m ON m.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER best <= 10"""


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH tokens AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM sizes),
queries AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM queries) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens))) AS impact FROM postings JOIN weights USING (term) JOIN sizes USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score FROM queries JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op5_secrets": report_sql(train(labelled_samples())), "op8_range_join": RANGE_JOIN_SQL, "op11_chunk_recipes": DUPLICATES_SQL, "op12_ball_negatives": NEGATIVES_SQL, "op13_cluster_search": SEARCH_SQL}
