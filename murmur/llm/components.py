"""Connected components of links between numbered nodes, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node that each node of ``edges`` (a, b)
    can reach.  Nodes without a link don't appear; loops and repeated links do
    no harm.

    Labels spread over links and then jump to their label's label, so a chain
    takes rounds in the logarithm of its length; rounds go on until nothing
    changes.  Every round is a table in the shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        # a node with very many links is one row a partition after partial aggregation
        near = (both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = written(step.join(far, "label").select("node", "was", F.least("label", "far").alias("label")), "labels")
        if not step.where("was <> label").limit(1).count():
            return step.select("node", "label")
        now = step.select("node", "label")
