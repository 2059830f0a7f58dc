"""Column helpers for the data behind charts (rendering is not built)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.ordered import ordered_scan


def date_label(ts: Column | str) -> Column:
    """``MM-dd`` label of a bin edge."""
    return F.date_format(ts, "MM-dd")


def corpus_share(p: Column | str, t: Column | str) -> Column:
    """Effective share of the corpus used, ``100 * (p + t - p * t)``."""
    p, t = F.col(p) if isinstance(p, str) else p, F.col(t) if isinstance(t, str) else t
    return F.lit(100.0) * (p + t - p * t)


def rewrite_threshold(df: DataFrame, value: float = 0.0, p_col: str = "p", t_col: str = "thresh") -> DataFrame:
    """``thresh := value`` on rows where ``p == 1`` (all labelled data used)."""
    return df.withColumn(t_col, F.when(F.col(p_col) == 1, F.lit(value)).otherwise(F.col(t_col)))


def log_scale_limit(df: DataFrame, col: str) -> DataFrame:
    """``log10`` of a column and its maximum, for axis limits."""
    return df.agg(F.max(F.log10(col)).alias("log_max"), F.max(col).alias("max"))


def legend_lines(words: DataFrame, key: str, order: str, word: str = "word", width: int = 100) -> DataFrame:
    """Wrap a label's words into lines: a new line starts once the running
    length (word + space) passes ``width``; ``(key, line_no, text)``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.length(word) + 1).over(w), F.lit(0))
    lines = words.withColumn("line_no", F.floor(run / width).cast("long"))
    return lines.groupBy(key, "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda s: s[word]), " ").alias("text"))


def rows_where(df: DataFrame, conditions: dict) -> DataFrame:
    """Rows in which every named column equals its value (a list: one of the
    values); a null value asks for nulls."""
    for name, value in conditions.items():
        c = F.col(name)
        df = df.filter(c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c.isNull() if value is None else c == F.lit(value))
    return df


def one_series(df: DataFrame, name: str, x: str, y: str, name_col: str = "name") -> DataFrame:
    """``(x, y)`` of one named series."""
    return df.filter(F.col(name_col) == name).select(F.col(x).alias("x"), F.col(y).alias("y"))


def row_series(df: DataFrame, series: str, order: list[str], y: str) -> DataFrame:
    """``(series, x, y)``: the rows of each series numbered from 0 in their order,
    so that several series lie side by side on one axis.  One ordered scan over
    all rows numbers all series, however long one of them is.  ``order`` must be
    a total order within a series."""
    scan = ordered_scan(df.select(*dict.fromkeys([series, *order, y])), [series, *order])
    first = scan.groupBy(F.col(series).alias("_s")).agg(F.min("_i").alias("_f"))
    # a null names a series, too
    return scan.join(first, F.col(series).eqNullSafe(F.col("_s"))).select(series, (F.col("_i") - F.col("_f")).alias("x"), F.col(y).alias("y"))


def series_means(rows: DataFrame, series: str) -> DataFrame:
    """``(series, mean, std, n)`` over the rows of each series."""
    return rows.groupBy(series).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.count("y").alias("n"))


def series_stats(df: DataFrame, series: str, x: str, y: str) -> DataFrame:
    """Mean, population std and count of ``y`` per ``(series, x)``."""
    return df.groupBy(series, x).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"),
                                     F.count(F.lit(1)).alias("n"))
