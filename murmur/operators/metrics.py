"""Classification metrics as aggregates: confusion, precision/recall/F1,
per-class report, rank-sum ROC AUC, misclassified rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.ordered import ordered_scan


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                   keys: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, F1 of class 1 (zero when undefined),
    optionally per group of ``keys``; one aggregate pass."""
    y, p = F.col(label), F.col(pred)
    agg = [F.count(F.lit(1)).alias("n"),
           F.sum(F.when(y == p, 1).otherwise(0)).alias("_ok"),
           F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("_tp"),
           F.sum(F.when(p == 1, 1).otherwise(0)).alias("_pp"),
           F.sum(F.when(y == 1, 1).otherwise(0)).alias("_ap")]
    g = df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)
    prec = _safe_div(F.col("_tp"), F.col("_pp"))
    rec = _safe_div(F.col("_tp"), F.col("_ap"))
    g = (g.withColumn("accuracy", F.col("_ok") / F.col("n"))
         .withColumn("precision", prec).withColumn("recall", rec)
         .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall"))))
    return g.drop("_ok", "_tp", "_pp", "_ap")


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class: precision, recall, F1, support; plus a support-weighted
    ``avg / total`` row.  Works on the (classes x classes) confusion table."""
    conf = confusion(df, label, pred)
    by_true = conf.groupBy(F.col(label).alias("c")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(F.col(pred).alias("c")).agg(F.sum("n").alias("npred"))
    r = by_true.join(by_pred, "c", "full").na.fill(0, ["support", "tp", "npred"])
    r = (r.withColumn("precision", _safe_div(F.col("tp"), F.col("npred")))
         .withColumn("recall", _safe_div(F.col("tp"), F.col("support")))
         .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall"))))
    rows = r.select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1",
                    F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    avg = rows.agg(F.lit("avg / total").alias("class"),
                   (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                   (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                   (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"),
                   tot.cast("long").alias("support"))
    return rows.unionByName(avg)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC by the rank-sum statistic (ties get average ranks).

    Rows are first aggregated per distinct score; the cumulative count over
    the score order is a distributed ordered scan, so no step needs all rows
    in one task.  Direct mode: pass the hard prediction as ``score``."""
    g = df.groupBy(F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("_np"))
    c = ordered_scan(g, ["_s"], value="_n", op="sum", acc_col="_cum")
    avg_rank = F.col("_cum") - (F.col("_n") - 1) / 2
    s = c.agg(F.sum(F.col("_np") * avg_rank).alias("_r"), F.sum("_np").alias("_p"),
              F.sum(F.col("_n") - F.col("_np")).alias("_q"))
    auc = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))
    return s.select(auc.alias("roc_auc"))


def misclassified(df: DataFrame, label: str = "label", pred: str = "prediction") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(false positives, false negatives, positives), each de-duplicated."""
    fp = df.filter((F.col(pred) != F.col(label)) & (F.col(label) != 1)).distinct()
    fn = df.filter((F.col(pred) != F.col(label)) & (F.col(label) == 1)).distinct()
    pos = df.filter(F.col(label) == 1)
    return fp, fn, pos


def score_summary(scores: DataFrame, keys: list[str], metrics=("f1", "precision", "recall")) -> DataFrame:
    """Mean and population std of each metric per condition, and count."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return scores.groupBy(*keys).agg(*aggs)
