"""Top-k per group that survives hot groups.

A plain ``row_number() OVER (PARTITION BY g ORDER BY ...)`` sends every row
of a group to one task; when one group holds a large share of the rows that
task does most of the work.  Here rows are first ranked inside
``(group, salt)`` sub-groups (the salt is a hash of the row's order key, so
a hot group is spread over ``salt_buckets`` tasks), only the first ``k`` of
each survive, and the final ranking per group sees at most
``k * salt_buckets`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank", salt_cols: list[str] | None = None,
                    salt_buckets: int = 32) -> DataFrame:
    """Rows ranked ``1..k`` inside each group by ``order`` (a total order)."""
    salt_src = [F.col(c) for c in (salt_cols or df.columns)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    first = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    out = first.withColumn(rank_col, F.row_number().over(w2).cast("long")).filter(F.col(rank_col) <= k)
    return out.drop("_salt", "_r1")
