"""Vector tables: which rows take part, packing, rotation, global order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import on_workers, written


def usable(table: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that can be compared: id and
    vector not null, all components finite, not all zero, and of the commonest
    length (the shorter one on a tie)."""
    on_workers(table.sparkSession)
    rows = table.select("vec_id", F.col(column).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common.n if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def moments(rows: DataFrame, column: str) -> tuple[np.ndarray, float]:
    """Second moments (d x d) and the greatest squared length of a vector
    column.  The driver gets one row a matrix entry."""
    def part(batches):
        total, most = None, 0.0
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
                most = max(most, float((x * x).sum(1).max()))
        if total is not None:
            values = np.append(total.ravel(), most)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "x"])

    got = rows.select(column).mapInArrow(part, "at int, x double").groupBy("at").agg(F.sum("x").alias("s"), F.max("x").alias("m")).collect()
    if not got:
        return np.zeros((0, 0)), 0.0
    d = int(round((len(got) - 1) ** 0.5))
    out = np.zeros(d * d)
    most = 0.0
    for r in got:
        if r.at == d * d:
            most = r.m
        else:
            out[r.at] = r.s
    return out.reshape(d, d), most


def with_index(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``idx``, the place of each row in the order (0 on), without a task
    that sees all rows: places within range partitions plus what the partitions
    before hold.  The result is a table in the shared folder."""
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    local = written(local, name)
    low = (1 << 33) - 1
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    counts = local.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    return (local.withColumn("_part", part).join(F.broadcast(counts), "_part")
            .withColumn("idx", F.col("_off") + F.col("_at").bitwiseAND(F.lit(low))).drop("_part", "_off", "_at"))
