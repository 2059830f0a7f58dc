"""Exact order-dependent scans without a single-partition window.

``row_number() OVER (ORDER BY k)`` and running aggregates over a *global*
order make Spark move every row into one task.  ``ordered_scan`` computes
the same values in three distributed steps, all of them JVM expressions (so
every column keeps its type and its nulls):

1. range-partition on the order key and sort inside each partition; the
   built-in increasing id then holds the partition and the place in it;
2. a window per partition folds the running aggregate there;
3. a per-partition summary (one row per partition, a proven bound) turned
   into offsets/carries by a tiny window and broadcast back.

The sorted partitions are persisted so both uses of them see the same range
bounds and row numbers; if an executor is lost the blocks are rebuilt from
lineage with the same shuffle dependency.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_OPEN = threading.local()


@contextmanager
def scans_released():
    """Scans made inside (by this thread) are released at the end: what is read
    from them must be collected or written by then."""
    mine: list[DataFrame] = []
    _OPEN.scans = [*getattr(_OPEN, "scans", []), mine]
    try:
        yield
    finally:
        _OPEN.scans = _OPEN.scans[:-1]
        for df in mine:
            df.unpersist()


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_scan(df: DataFrame, order_cols: list[str], value: str | None = None,
                 op: str = "sum", minus_index: bool = False, index_col: str = "_i",
                 acc_col: str = "_acc", partitions: int | None = None) -> DataFrame:
    """Add the exact 0-based global row index (``index_col``) in ``order_cols``
    order, and optionally the inclusive running ``op`` (``sum``/``min``) of
    ``value`` (of ``value - index`` when ``minus_index``) as ``acc_col``.

    ``order_cols`` must be a total order (add a unique tie-break column).  A
    NULL value takes a place in the order and is left out of the running
    aggregate; no other row is touched by it.
    """
    if op not in ("sum", "min"):
        raise ValueError("op must be 'sum' or 'min'")
    p = _partitions(df, partitions)
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols)
    kept = ranged.withColumn("_at", at).persist(StorageLevel.MEMORY_AND_DISK)
    for open_scans in getattr(_OPEN, "scans", []):
        open_scans.append(kept)
    scanned = (kept.withColumn("_pid", F.shiftright("_at", 33))
               .withColumn("_j", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"))
    fold = F.min if op == "min" else F.sum
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        local = F.col(value) - F.col("_j") if minus_index else F.col(value)
        aggs.append(fold(local).alias("_last"))
    # one row per partition: the window below runs over at most `p` rows
    stats = scanned.groupBy("_pid").agg(*aggs)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if value is not None:
        part = F.col("_last") - F.col("_off") if minus_index else F.col("_last")
        stats = stats.withColumn("_carry", fold(part).over(before))
        # one partition of the order is one group: no larger than it was
        here = Window.partitionBy("_pid").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
        scanned = scanned.withColumn("_lacc", fold(local).over(here))
    out = scanned.join(F.broadcast(stats.drop("_n", "_last")), "_pid")
    out = out.withColumn(index_col, F.col("_off") + F.col("_j"))
    if value is not None:
        near = F.col("_lacc") - F.col("_off") if minus_index else F.col("_lacc")
        if op == "min":
            acc = F.least(F.col("_carry"), near)
        else:
            acc = F.coalesce(F.col("_carry") + near, near, F.col("_carry"))
        out = out.withColumn(acc_col, acc).drop("_lacc", "_carry")
    return out.drop("_pid", "_j", "_off")


def with_row_index(df: DataFrame, order_cols: list[str], name: str = "_i",
                   partitions: int | None = None) -> DataFrame:
    """Exact 0-based ``row_number() - 1`` over a global order, distributed."""
    return ordered_scan(df, order_cols, index_col=name, partitions=partitions)
