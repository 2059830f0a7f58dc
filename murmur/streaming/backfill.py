"""Backfill with a stored cursor: batch after batch of a landed table, newest
first, each going on below the oldest id of the one before.

The rows of batch ``n`` are written to a folder of their own; the batch counts
once its cursor row is published in another, and the row says where the next one
starts.  A run that dies in between leaves rows that nobody reads: the next run
writes the same batch again.  So each row is delivered once, whatever was killed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from murmur.operators.ordered import ordered_scan, scans_released
from murmur.operators.relational import in_id_range, latest_by_id_range

CURSOR = "batch long, oldest_id long, n_rows long"


class Backfill:
    """Reads ``source`` into ``path`` in batches of ``page_size * max_pages`` rows
    with ids above ``since_id`` and up to ``max_id`` that ``match``."""

    def __init__(self, source: DataFrame, path: str, id_col: str, since_id: int | None = None, max_id: int | None = None, match=None,
                 page_size: int = 100, max_pages: int = 101):
        self.source, self.path, self.id_col = source, path, id_col
        self.since_id, self.max_id, self.match, self.page_size, self.max_pages = since_id, max_id, match, page_size, max_pages
        self.spark: SparkSession = source.sparkSession

    def cursors(self) -> DataFrame:
        """The published cursor rows, one a batch."""
        try:
            return self.spark.read.schema(CURSOR).option("recursiveFileLookup", True).json(f"{self.path}/cursor")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], CURSOR)
            raise

    def last(self) -> Row | None:
        return self.cursors().orderBy(F.col("batch").desc()).limit(1).first()

    def step(self) -> bool:
        """Read and publish the next batch; False if the last one was empty."""
        last = self.last()
        if last is not None and last.n_rows == 0:
            return False
        batch, upto = (0, self.max_id) if last is None else (last.batch + 1, last.oldest_id - 1)
        if self.since_id is not None and upto is not None and upto <= self.since_id and last is not None:
            rows, n, oldest = None, 0, None  # nothing can be left
        else:
            rows = latest_by_id_range(self.source, self.id_col, self.since_id, upto, self.match, self.page_size, self.max_pages)
            rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
            done = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/batch={batch}")
            n, oldest = done.agg(F.count(F.lit(1)), F.min(self.id_col)).first()
        self.publish(batch, oldest, n)
        return n > 0

    def publish(self, batch: int, oldest, n: int) -> None:
        row = self.spark.createDataFrame([(batch, oldest, n)], CURSOR)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/cursor/{batch}")

    def rest(self) -> None:
        """All batches that hold a row, in one pass: an ordered scan numbers the rows,
        each batch gets its folder, and their cursor rows are published together.
        Rows of a repeated id are left to :meth:`step`, as what a batch takes then
        depends on the one before."""
        last = self.last()
        if last is not None and (last.n_rows == 0 or self.since_id is not None and last.oldest_id - 1 <= self.since_id):
            return
        first, upto = (0, self.max_id) if last is None else (last.batch + 1, last.oldest_id - 1)
        rows = in_id_range(self.source, self.id_col, self.since_id, upto, self.match)
        size, place = self.page_size * self.max_pages, f"{self.path}/rows"
        with scans_released():
            scan = ordered_scan(rows.withColumn("_k", -F.col(self.id_col)), ["_k"])
            n, ids = scan.agg(F.count(F.lit(1)), F.countDistinct(self.id_col)).first()
            if n == 0 or ids < n:
                return
            numbered = scan.withColumn("page", F.floor(F.col("_i") % size / self.page_size)).withColumn("batch", F.floor(F.col("_i") / size) + first).drop("_k", "_i")
            # batches that a killed run left are replaced
            numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(place)
        done = self.spark.read.schema(numbered.schema).option("basePath", place).parquet(place)
        mine = done.where((F.col("batch") >= first) & (F.col("batch") < first + -(-n // size)))
        cursors = mine.groupBy("batch").agg(F.min(self.id_col).alias("oldest_id"), F.count(F.lit(1)).alias("n_rows"))
        cursors.coalesce(1).write.mode("overwrite").json(f"{self.path}/cursor/{first}")

    def run(self, batches: int | None = None) -> "Backfill":
        """Go on from the stored cursor to the end (or for so many batches)."""
        if batches is None:
            self.rest()
        while (batches is None or batches > 0) and self.step():
            batches = None if batches is None else batches - 1
        return self

    def rows(self) -> DataFrame:
        """The rows of all published batches, with ``batch`` and ``page``."""
        there = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").withColumn("batch", F.col("batch").cast("long"))
        return there.join(F.broadcast(self.cursors().select("batch")), "batch", "left_semi")  # a row a batch
