"""Solvers over wide features: how many at once, and in how many tasks."""

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from murmur.operators import experiments as EX


def test_solvers_side_by_side_are_bounded_by_their_width():
    assert [EX.side_by_side(w, 8) for w in (0, 10, 150_000, 5_000_000)] == [8, 8, 4, 1]


def test_width_is_that_of_the_vectors(spark):
    rows = spark.createDataFrame([(2, Vectors.sparse(70, [3], [1.0]))], ["id", "features"])
    assert EX.feature_width(rows) == 70 and EX.feature_width(rows.limit(0)) == 0 and EX.feature_width(rows.drop("features")) == 0


def test_tasks_of_a_pass_do_not_grow_beyond_those_that_run_at_once(spark):
    cores = spark.sparkContext.defaultParallelism
    assert EX.task_count(spark.range(1), 1) == 1
    assert EX.task_count(spark.range(1), EX.TASK_BYTES * (cores + 50)) == cores
    rows, n, kept = EX.laid_out(spark.range(100).withColumn("x", F.lit(1.0)))
    assert n == 100 and rows.rdd.getNumPartitions() <= cores
    kept.unpersist()
