"""Corpus pipeline: from raw documents to token ids, five stages of the training-data operators.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the last return the columns of
documents, extra columns included. Null and empty texts and null ids go through every stage: the classifier scores them, the join leaves them, the scan finds nothing in them, the mix never
takes them (they hold no words). Of rows alike in id and text the join keeps one. An empty table gives an empty result. ``run`` writes each stage's result as Parquet in the session's shared folder and reads it again for the next, so a lost executor costs no more
than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regmart.llm import bpe, jaccard, mixing, quality, secrets
from regmart.llm.common import shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join over five-word shingles at 0.8: of each group the row with the least doc_id stays; texts without words all stay."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: documents stay, the secrets in their texts are masked, and n_chars follows."""
    masked = secrets.redact_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each time that the mix takes a document, in training order."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: doc_id, token_ids and the text decoded from them."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("jaccard", one_of_each_group), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", to_tokens)]

#: Trained and string-level stages are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
