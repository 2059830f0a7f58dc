"""Filters, labels and joins over message tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.wordlists import MAX_INLINE_WORDS
from murmur.operators.ordered import with_row_index


def keyword_filter(docs: DataFrame, keywords: Iterable[str], tokens_col: str = "tokens") -> DataFrame:
    """Rows whose tokens contain any keyword (``IN`` list -> hash set).  A list
    too long to inline is matched as a table; nulls never match."""
    kw = list(dict.fromkeys(keywords))
    if len(kw) > MAX_INLINE_WORDS:
        rows = docs.withColumn("_row", F.monotonically_increasing_id()).persist()
        words = docs.sparkSession.createDataFrame([(k,) for k in kw], "token string")
        tokens = rows.select("_row", F.explode(tokens_col).alias("token"))
        return rows.join(keyword_semi_join(tokens, words, "_row"), "_row", "left_semi").drop("_row")
    return docs.filter(F.exists(tokens_col, lambda t: t.isin(kw)))


def keyword_semi_join(tokens_long: DataFrame, keywords: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents having a token in a keyword table of any size."""
    kw = keywords.select(F.col(keywords.columns[0]).alias("token")).distinct()
    return tokens_long.join(kw, "token", "left_semi").select(id_col).distinct()


def label_by_membership(messages: DataFrame, positive_ids: DataFrame, id_col: str = "id_str",
                        label_col: str = "label") -> DataFrame:
    """``label = 'T'`` when the id is in ``positive_ids`` else ``'F'``.

    The id list is de-duplicated by an aggregate (partial, map side) and
    joined without a hint; AQE broadcasts it when it is small at run time.
    """
    ids = positive_ids.select(F.col(positive_ids.columns[0]).alias(id_col)).distinct() \
        .withColumn("_hit", F.lit(True))
    out = messages.join(ids, id_col, "left")
    return out.withColumn(label_col, F.when(F.col("_hit"), F.lit("T")).otherwise(F.lit("F"))).drop("_hit")


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def date_range_filter(df: DataFrame, ts_col: str, lo=None, hi=None) -> DataFrame:
    """Inclusive ``lo <= ts <= hi``; a missing bound is the data's min / max
    (which keeps every row on that side, as the reference default does)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(ts_col) >= F.lit(lo).cast(df.schema[ts_col].dataType))
    if hi is not None:
        cond = cond & (F.col(ts_col) <= F.lit(hi).cast(df.schema[ts_col].dataType))
    return df.filter(cond & F.col(ts_col).isNotNull())


def in_id_range(df: DataFrame, id_col: str, since_id: int | None = None, max_id: int | None = None, match: Column | None = None) -> DataFrame:
    """Rows with ``since_id < id <= max_id`` that ``match``."""
    if since_id is not None and max_id is not None and since_id >= max_id:
        raise ValueError(f"since_id {since_id} must be below max_id {max_id}")
    cond = F.lit(True)
    if since_id is not None:
        cond = cond & (F.col(id_col) > since_id)
    if max_id is not None:
        cond = cond & (F.col(id_col) <= max_id)
    if match is not None:
        cond = cond & match
    return df.filter(cond)


def latest_by_id_range(df: DataFrame, id_col: str, since_id: int | None = None,
                       max_id: int | None = None, match: Column | None = None,
                       page_size: int = 100, max_pages: int = 101) -> DataFrame:
    """Newest-first pages of rows with ``since_id < id <= max_id``.

    Ids are compared as numbers.  ``limit`` is the feature here (the paged
    search returns at most ``page_size * max_pages`` rows); Spark plans it as
    a per-partition top-k with one bounded merge.
    """
    top = in_id_range(df, id_col, since_id, max_id, match).orderBy(F.col(id_col).desc()).limit(page_size * max_pages)
    rn = F.row_number().over(Window.orderBy(F.col(id_col).desc())) - 1
    return top.withColumn("page", (rn / page_size).cast("long"))


def backfill(search, max_id: int | None = None, id_col: str = "id"):
    """Walk newest-first pages to the end: yields each batch that ``search(max_id)``
    returns and goes on below its oldest id until a batch is empty.  One row of
    each batch (its oldest id, which may be stored as the cursor) reaches the
    driver."""
    while True:
        batch = search(max_id)
        oldest = next_cursor(batch, id_col).first()["oldest_id"]
        if oldest is None:
            return
        yield batch
        max_id = oldest - 1


def next_cursor(page: DataFrame, id_col: str) -> DataFrame:
    """The oldest id of a batch: the next ``max_id`` (exclusive: ``min - 1``)."""
    return page.agg(F.min(id_col).alias("oldest_id"))


def stopword_anti(tokens_long: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Drop stop words from a long token table with an anti-join; AQE
    broadcasts a list that is small at run time."""
    stop = stopwords.select(F.col(stopwords.columns[0]).alias("token")).distinct()
    return tokens_long.join(stop, "token", "left_anti")


def union_corpora(*frames: tuple[str, DataFrame]) -> DataFrame:
    """Tag each frame with its corpus name and stack them by column name."""
    out = None
    for name, df in frames:
        tagged = df.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def train_and_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows under train rows, to be vectorised together; ``split`` tells
    them apart again."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def label_encode(df: DataFrame, col: str, out: str = "label_id") -> DataFrame:
    """Index of the value among the sorted distinct values (0-based).

    Distinct values are aggregated first (partial aggregation) and numbered
    by the distributed ordered scan, so even a high-cardinality column never
    meets a single-partition window.  Nulls keep a null index.
    """
    vals = df.select(col).distinct().filter(F.col(col).isNotNull())
    vals = with_row_index(vals, [col], out)
    return df.join(vals, col, "left")
