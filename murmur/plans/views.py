"""Derived views shared by the registered queries (Spark side).

Each has a DuckDB twin in :mod:`murmur.plans.sqlviews` with the same text.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.text import clean_and_tokenize, normalize_format
from murmur.functions.wordlists import DEFAULT_STOPWORDS
from murmur.session import spread, table

# BOW settings of the reference transformer (no_below=2, no_above=0.9)
BOW_NO_BELOW = 2
BOW_NO_ABOVE = 0.9
BOW_KEEP_N = 100_000  # the feature of vocab_filter_extremes only


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def doc_tokens(spark: SparkSession, sf: str, stop=DEFAULT_STOPWORDS) -> DataFrame:
    """``(doc_id, tokens)``: cleaned, validated tokens of every document."""
    docs = documents(spark, sf)
    toks = docs.select("doc_id", clean_and_tokenize(normalize_format("text"), stop).alias("tokens"))
    # token arrays feed several branches (vocabulary, pairs, counts, joins):
    # run the text rules once and keep the (smaller) token table
    return toks.persist(StorageLevel.MEMORY_AND_DISK)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label (``quality``)."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf).join(lab, "doc_id")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with a fixed-rule prediction and score."""
    return (labelled(spark, sf)
            .withColumn("prediction", F.when(F.col("n_chars") > 500, 1).otherwise(0))
            .withColumn("score", F.col("n_chars").cast("double")))


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(word, vector array<double>)`` from the embeddings table."""
    emb = table(spark, sf, "embeddings")
    return emb.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                      F.col("embedding").cast("array<double>").alias("vector"))


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, pos, vector)``: embeddings laid out as messages of ten tokens."""
    emb = table(spark, sf, "embeddings")
    return emb.select(F.expr("vec_id div 10").alias("doc_id"), F.col("vec_id").alias("pos"),
                      F.col("embedding").cast("array<double>").alias("vector"))
