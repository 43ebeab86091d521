"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabgrain.llm import exact_dedup, ngram_join, packing, quality_cnn, secret_scan
from fabgrain.llm.common import bounded_batches, table
from fabgrain.session import durable

#: Sequence length and the id that ends a document.
ROOM, END_ID = 2048, 0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts; it learns from the labels in ``sf_dir`` that are not held out.

    Null and empty texts are scored like others, repeated rows share their fate, an empty table stays empty. Without labels
    of both kinds every document stays.
    """
    bounded_batches(spark)
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.keep_good(docs, model)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, that with the largest id; of rows that repeat it, one.

    A null text equals an empty one, a null id is smaller than any other, an empty table stays empty.
    """
    bounded_batches(spark)
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar n-gram sets link, that with the smallest id.

    Texts without words, and rows with a null id, are linked with nothing and stay; rows that repeat the smallest id all stay; an
    empty table stays empty.
    """
    bounded_batches(spark)
    return ngram_join.one_of_each(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and ``n_chars`` of the masked text.

    A null text stays null, with a null ``n_chars``; an empty one stays empty. Every row is looked at for itself.
    """
    bounded_batches(spark)
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of ``ROOM`` tokens.

    A null or empty text is one piece of the end id alone; rows that repeat an id, or have none, are packed like others; an
    empty table has no pieces.
    """
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ROOM, END_ID)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", no_copies),
    ("ngram_join", no_near_copies),
    ("secret_scan", no_secrets),
    ("best_fit_packing", packed),
]

#: The network's scores, the masking and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
