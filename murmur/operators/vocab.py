"""Vocabulary, bag of words and TF-IDF over token arrays.

Inputs are ``(doc_id, tokens array<string>)`` frames.  The bag of words is
counted inside each document row (sort + run lengths, all JVM expressions),
so building it moves no data; only the vocabulary aggregate shuffles, after
map-side partial aggregation (one row per token per partition, which also
defuses hot tokens).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.ordered import with_row_index


def with_token_counts(docs: DataFrame, tokens_col: str = "tokens", out: str = "_bag") -> DataFrame:
    """Add ``out``: ``array<struct<token, tf>>`` of the distinct tokens of the
    row and their counts, in token order (sort, then run lengths).

    The sorted array and the run starts are materialised as their own columns
    first: a lambda that referenced ``array_sort(...)`` directly would re-sort
    the array for every element.
    """
    # sort_array compares natively, array_sort by a lambda; it puts nulls first, so they are put back
    words = F.array_compact(tokens_col)
    d = docs.withColumn("_s", F.concat(F.sort_array(words), F.array_repeat(F.lit(None).cast("string"), F.size(tokens_col) - F.size(words))))
    n = F.size("_s")
    s = F.col("_s")
    d = d.withColumn("_st", F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (n > 0) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1)))))
    st = F.col("_st")
    d = d.withColumn(out, F.transform(
        st, lambda start, k: F.struct(
            F.get(s, start).alias("token"),
            (F.coalesce(F.get(st, k + 1), n) - start).cast("long").alias("tf"))))
    return d.drop("_s", "_st")


def bag_of_words(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, token, tf)`` and the columns ``keep`` of the document: one row
    per distinct token of each document, counted inside the document row (no shuffle)."""
    bag = with_token_counts(docs.select(id_col, *keep, tokens_col), tokens_col)
    return (bag.select(id_col, *keep, F.explode_outer("_bag").alias("b"))
            .filter(F.col("b").isNotNull()).select(id_col, *keep, "b.token", "b.tf"))


def tokens_long(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``(doc_id, pos, token)`` with 0-based positions."""
    return explode_positions(docs, id_col, tokens_col)


def explode_positions(df: DataFrame, id_col: str, arr_col: str, pos: str = "pos",
                      value: str = "token") -> DataFrame:
    """``(id, pos, value)`` rows of an array column, 0-based ``pos`` as bigint.

    ``posexplode_outer`` + a null filter instead of ``posexplode``: the inner
    form makes Catalyst infer ``size(arr) > 0`` and push a copy of the whole
    array expression down to the scan, computing it twice.
    """
    return (df.select(id_col, F.posexplode_outer(arr_col).alias(pos, value))
            .filter(F.col(pos).isNotNull())
            .withColumn(pos, F.col(pos).cast("long")))


def vocabulary(bow: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(token, df, cf, first_doc)``: document and corpus frequency."""
    return bow.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum("tf").alias("cf"),
        F.min(id_col).alias("first_doc"),
    )


def count_docs(docs: DataFrame) -> Column:
    """Number of documents as a lazy scalar subquery."""
    return docs.select(F.count(F.lit(1))).scalar()


def filter_extremes(vocab: DataFrame, n_docs: Column | int, no_below: int = 5,
                    no_above: float = 0.5, keep_n: int | None = None) -> DataFrame:
    """Keep ``no_below <= df <= floor(no_above * n_docs)``, then the ``keep_n``
    tokens of highest df (ties by token; None: all).  Adds ``token_id``: ids follow first
    appearance (first document, then token order), renumbered densely.
    """
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    kept = vocab.filter((F.col("df") >= no_below) & (F.col("df") <= F.floor(n * F.lit(no_above))))
    if keep_n is not None:
        # top-k: per-partition top keep_n, then one bounded merge
        kept = kept.orderBy(F.col("df").desc(), F.col("token")).limit(keep_n)
        w = Window.orderBy("first_doc", "token")
        return kept.withColumn("token_id", (F.row_number().over(w) - 1).cast("long"))
    return with_row_index(kept, ["first_doc", "token"], "token_id")


def doc2bow(bow: DataFrame, kept: DataFrame, broadcast_vocab: bool = False) -> DataFrame:
    """``(doc_id, token_id, token, tf)`` restricted to the kept vocabulary.

    A vocabulary without ``keep_n`` has no bound, so the join carries no hint
    (AQE broadcasts it if it is small at run time); set ``broadcast_vocab`` for
    one that ``keep_n`` bounds.
    """
    v = kept.select("token", "token_id", "df")
    v = F.broadcast(v) if broadcast_vocab else v
    return bow.join(v, "token")


def tfidf(bow: DataFrame, kept: DataFrame, n_docs: Column | int, id_col: str = "doc_id",
          eps: float = 1e-12, broadcast_vocab: bool = False) -> DataFrame:
    """``(doc_id, token_id, token, tf, weight)``: ``tf * log2(N / df)``,
    L2-normalised per document; zero-idf terms and ``|w| <= eps`` dropped."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    b = doc2bow(bow, kept, broadcast_vocab)
    raw = b.withColumn("_w", F.col("tf") * F.log2(n / F.col("df"))).filter(F.col("_w") != 0)
    # per-document norm as an aggregate (partial, map side) joined back: a
    # very long document is split by AQE's skew-join handling, which a
    # per-document window could not do
    norms = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    out = raw.join(norms, id_col).withColumn("weight", F.col("_w") / F.col("_norm")) \
        .filter(F.abs("weight") > eps)
    return out.select(id_col, "token_id", "token", "tf", "weight")


def top_terms(weights: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The ``k`` highest-weight terms of each document (ties by token)."""
    # a document's distinct terms are a small group: one window, no salt
    w = Window.partitionBy(id_col).orderBy(F.col("weight").desc(), F.col("token"))
    return weights.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


