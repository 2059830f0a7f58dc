"""Steps 6-7: metrics over a fixed-rule prediction; folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import plotdata as P
from murmur.operators import metrics as M
from murmur.operators import sampling as S
from murmur.plans import views
from murmur.plans.registry import query
from murmur.plans.sqlviews import LABELLED, PREDICTIONS, with_
from murmur.session import table

PRED = with_(("labelled", LABELLED), ("predictions", PREDICTIONS))
_SAFE = "CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"


def _r(c):
    return F.round(c, 6).alias(c)


@query("confusion_matrix", PRED + "SELECT label, prediction, count(*) AS n FROM predictions GROUP BY ALL")
def confusion_matrix(spark, sf):
    return M.confusion(views.predictions(spark, sf))


_BM = ("SELECT n, round(ok / n, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall, "
       "round(CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END, 6) AS f1 FROM ("
       "SELECT *, " + _SAFE.format(a="tp", b="pp") + " AS prec, " + _SAFE.format(a="tp", b="ap") + " AS rec FROM ("
       "SELECT {keys} count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS ok, "
       "sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp, "
       "sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS pp, "
       "sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS ap FROM predictions {group}))")


@query("binary_metrics", PRED + _BM.format(keys="", group=""))
def binary_metrics(spark, sf):
    m = M.binary_metrics(views.predictions(spark, sf))
    return m.select("n", _r("accuracy"), _r("precision"), _r("recall"), _r("f1"))


@query("class_report", PRED + """, conf AS (SELECT label, prediction, count(*) AS n FROM predictions GROUP BY ALL),
t AS (SELECT label AS c, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM conf GROUP BY label),
p AS (SELECT prediction AS c, sum(n) AS npred FROM conf GROUP BY prediction),
r AS (SELECT coalesce(t.c, p.c) AS c, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(npred, 0) AS npred
      FROM t FULL JOIN p ON t.c = p.c),
m AS (SELECT c::VARCHAR AS class, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS precision,
      CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support::BIGINT AS support FROM r),
m2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m),
a AS (SELECT class, precision, recall, f1, support FROM m2 UNION ALL
      SELECT 'avg / total', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support)::BIGINT FROM m2)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a""")
def class_report(spark, sf):
    r = M.class_report(views.predictions(spark, sf))
    return r.select("class", _r("precision"), _r("recall"), _r("f1"), "support")


_AUC = (PRED + ", rk AS (SELECT label, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r "
        "FROM predictions), agg AS (SELECT sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rs, "
        "sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::DOUBLE AS q FROM rk) "
        "SELECT round((rs - p * (p + 1) / 2) / (p * q), 6) AS roc_auc FROM agg")


@query("roc_auc", _AUC.format(s="score"))
def roc_auc(spark, sf):
    return M.roc_auc(views.predictions(spark, sf), "label", "score").select(_r("roc_auc"))


@query("roc_auc_direct", _AUC.format(s="prediction"))
def roc_auc_direct(spark, sf):
    return M.roc_auc(views.predictions(spark, sf), "label", "prediction").select(_r("roc_auc"))


@query("false_positives", PRED + "SELECT DISTINCT doc_id, n_chars FROM predictions WHERE prediction <> label AND label <> 1")
def false_positives(spark, sf):
    fp, _, _ = M.misclassified(views.predictions(spark, sf).select("doc_id", "n_chars", "label", "prediction"))
    return fp.select("doc_id", "n_chars").distinct()


@query("false_negatives", PRED + "SELECT DISTINCT doc_id, n_chars FROM predictions WHERE prediction <> label AND label = 1")
def false_negatives(spark, sf):
    _, fn, _ = M.misclassified(views.predictions(spark, sf).select("doc_id", "n_chars", "label", "prediction"))
    return fn.select("doc_id", "n_chars").distinct()


# score log: one row per (lang, source) condition of the fixed-rule prediction
_SCORE_LOG = _BM.format(keys="lang AS name, source AS trial,", group="GROUP BY lang, source").replace(
    "SELECT n, ", "SELECT name, trial, n, ")


@query("score_summary", PRED + ", score_log AS (" + _SCORE_LOG + ") "
       "SELECT name, count(*) AS n, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, "
       "round(avg(precision), 6) AS precision_mean, round(stddev_pop(precision), 6) AS precision_std, "
       "round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std FROM score_log GROUP BY name")
def score_summary(spark, sf):
    log = M.binary_metrics(views.predictions(spark, sf), keys=["lang", "source"])
    log = log.select(F.col("lang").alias("name"), F.col("source").alias("trial"), "n",
                     *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
    s = M.score_summary(log, ["name"])
    return s.select("name", "n", *[_r(c) for c in s.columns if c.endswith(("_mean", "_std"))])


@query("stratified_folds", with_(("labelled", LABELLED)) +
       "SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) - 1) % 3)::BIGINT AS fold FROM labelled")
def stratified_folds(spark, sf):
    lab = views.labelled(spark, sf).select("doc_id", "label")
    return S.stratified_folds(lab, "label", "doc_id", k=3, seed=7).select("doc_id", "label", "fold")


@query("exact_split",
       "SELECT doc_id, (row_number() OVER (ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) - 1) < ceil(0.3 * (SELECT count(*) FROM documents)) AS in_sample FROM documents")
def exact_split(spark, sf):
    docs = views.documents(spark, sf).select("doc_id")
    return S.exact_split(docs, "doc_id", 0.3, seed=3).select("doc_id", "in_sample")


_LOG_ROWS = """, g AS (SELECT lang, source, count(*) AS n,
    sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS ok,
    sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS pp,
    sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS ap FROM predictions GROUP BY lang, source),
m AS (SELECT *, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS prec, CASE WHEN ap = 0 THEN 0.0 ELSE tp / ap END AS rec FROM g),
log AS (SELECT (dense_rank() OVER (ORDER BY source) - 1) AS n_trial, (dense_rank() OVER (ORDER BY lang) - 1) AS i,
    lang AS name, n AS size, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END AS p, 0.3 AS thresh,
    CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM m),
ids AS (SELECT name, dense_rank() OVER (ORDER BY min(n_trial * 1000 + i)) AS name_id FROM log GROUP BY name),
fixed AS (SELECT log.*, ids.name_id, CASE WHEN p = 1 THEN 0.0 ELSE thresh END AS t2 FROM log JOIN ids USING (name))
"""


@query("score_log_scan", PRED + _LOG_ROWS +
       "SELECT name_id::BIGINT AS name_id, round(t2, 6) AS thresh, round(100.0 * (p + t2 - p * t2), 6) AS share, "
       "count(*) AS n, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM fixed GROUP BY name_id, t2, p")
def score_log_scan(spark, sf):
    """The score log written with the append sink, read back with the
    score-log reader (names numbered by first appearance), ``thresh``
    rewritten where all labelled data is used, summarised per condition."""
    import uuid
    from pyspark.sql import Window
    from murmur.functions.plotdata import corpus_share, rewrite_threshold
    from murmur.session import scratch_path
    from murmur.sources import io as IO
    m = M.binary_metrics(views.predictions(spark, sf), keys=["lang", "source"])
    log = m.select(
        (F.dense_rank().over(Window.orderBy("source")) - 1).alias("n_trial"),
        (F.dense_rank().over(Window.orderBy("lang")) - 1).alias("i"),
        F.col("lang").alias("name"), F.col("n").cast("int").alias("size"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.5).alias("p"), F.lit(0.3).alias("thresh"),
        F.col("n").cast("int").alias("n_rows"), F.lit(None).cast("double").alias("corpus_size"),
        "accuracy", "precision", "recall", "f1", F.lit(None).cast("double").alias("roc_auc"),
        F.lit(0).alias("n_components"), F.lit("rule").alias("clf_base"))
    log = log.withColumn("corpus_size", corpus_share("p", "thresh"))
    path = scratch_path(spark, f"scores-{uuid.uuid4().hex}")
    log.select(*[f.name for f in IO.SCORE_LOG_SCHEMA.fields]).write.mode("append").csv(path)
    back = rewrite_threshold(IO.read_score_log(spark, path), 0.0)
    out = back.groupBy("name_id", "thresh", "p").agg(
        F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"))
    return out.select("name_id", _r("thresh"), F.round(corpus_share("p", "thresh"), 6).alias("share"), "n",
                      _r("f1_mean"), _r("f1_std"))


@query("row_series", """SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS x, n_chars AS y FROM documents""")
def row_series(spark, sf):
    """The documents of each language, shortest first, numbered side by side."""
    return P.row_series(table(spark, sf, "documents"), "lang", ["n_chars", "doc_id"], "n_chars")


@query("series_means", """SELECT lang, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, count(*) AS n FROM documents GROUP BY lang""")
def series_means(spark, sf):
    m = P.series_means(P.row_series(table(spark, sf, "documents"), "lang", ["n_chars", "doc_id"], "n_chars"), "lang")
    return m.select("lang", _r("mean"), _r("std"), "n")


@query("chart_series", """SELECT n_chars AS x, doc_id AS y FROM documents WHERE lang IN ('en', 'de') AND source = 'src1'""")
def chart_series(spark, sf):
    """One named series of the rows that meet all conditions."""
    return P.one_series(P.rows_where(table(spark, sf, "documents"), {"lang": ["en", "de"]}), "src1", "n_chars", "doc_id", "source")


@query("date_labels", "SELECT strftime(ts, '%m-%d') AS label, event_type, count(*) AS n FROM events GROUP BY ALL")
def date_labels(spark, sf):
    return table(spark, sf, "events").groupBy(P.date_label("ts").alias("label"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("legend_lines", """WITH w AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS o FROM (SELECT DISTINCT lang, source FROM documents)),
l AS (SELECT *, coalesce(sum(length(source) + 1) OVER (PARTITION BY lang ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 30 AS line_no FROM w)
SELECT lang, line_no::BIGINT AS line_no, string_agg(source, ' ' ORDER BY o) AS text FROM l GROUP BY ALL""")
def legend_lines(spark, sf):
    """The sources of each language wrapped into lines of about 30 characters."""
    words = table(spark, sf, "documents").select("lang", "source").distinct()
    return P.legend_lines(words.withColumn("o", F.col("source")), "lang", "o", "source", 30)
