"""A corpus through four stages: toxicity, near duplicates, secrets, packing.

Each stage gets the documents that the one before it kept, as a table that was written and
reread, and works on all of them. All but the last return the columns of documents, whatever these
are: columns that a stage doesn't read keep their names, types and values.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import batch_rows, fanned_out, join_hot, table, written
from quarryline.llm.order_minhash import kept_texts, text_hash
from quarryline.llm.packing import packed
from quarryline.llm.secrets import labelled_samples, redacted, train
from quarryline.llm.toxicity import fit, scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier takes for toxic; rows without text stay."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    batch_rows(spark)
    return fanned_out(docs).where(scores(model)("text") < 0.5)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest doc_id.

    Rows count by their own texts, also where they share a doc_id; of rows with equal doc_id and
    text the one whose other columns come first, written as JSON, stays. Rows without a doc_id all stay.
    """
    key = ["doc_id", "text_hash"]
    others = [F.col("record").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(others)])) if others else F.lit("")
    rows = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id"), text_hash().alias("text_hash"))
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    kept = written(kept_texts(docs).join(counts, key), "kept")
    known = join_hot(rows, kept, key, "n", docs.count())
    # Repeated rows become one before they are shuffled, so no key is large; others aren't grouped.
    one = known.where("n > 1").groupBy(*key).agg(F.min_by("record", order).alias("record"))
    return known.where("n = 1").select("record").unionByName(one.select("record")).select("record.*").unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars, where there is one, brought up to date."""
    clean = redacted(docs, train(labelled_samples()))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in padded batches of token ids; for each its bucket, batch and slot, read back."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("secrets", secrets), ("packing", packing)]

#: A trained classifier, sketches and an optimal packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
