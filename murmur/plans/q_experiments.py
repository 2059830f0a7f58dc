"""Experiments read from one saved table of out-of-fold predictions.  The
classifier is the nearest class mean of the message length, so that every step
(folds, fits, predictions, what is read from them) has a statement in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from murmur.operators import experiments as EX
from murmur.operators.vectors import block_coordinates, feature_rows, feature_slice, message_vector_blocks
from murmur.plans import views
from murmur.plans.registry import query
from murmur.session import scratch_path, table

# rows (grp, n_trial, id, x, label) -> folds, means of the other folds, predictions
_FOLDS = """f AS (SELECT *, (row_number() OVER (PARTITION BY grp, n_trial, label ORDER BY md5(n_trial || ':' || doc_id), doc_id) - 1) % {k} AS fold
  FROM (SELECT d.*, t::BIGINT AS n_trial FROM data d, range({trials}) r(t))),
m AS (SELECT x.grp, x.n_trial, x.fold, avg(CASE WHEN f.label = 0 THEN n_chars END) AS a, avg(CASE WHEN f.label = 1 THEN n_chars END) AS b
  FROM (SELECT DISTINCT grp, n_trial, fold FROM f) x JOIN f ON f.grp = x.grp AND f.n_trial = x.n_trial AND f.fold <> x.fold GROUP BY ALL),
s AS (SELECT f.*, CASE WHEN a IS NULL THEN 1 WHEN b IS NULL THEN -1 ELSE abs(n_chars - a) - abs(n_chars - b) END::DOUBLE AS score FROM f JOIN m USING (grp, n_trial, fold)),
p AS (SELECT *, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS prediction FROM s)"""
_LAB = "lab AS (SELECT d.doc_id, d.text, d.n_chars, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"
_ONE = f"WITH {_LAB}, data AS (SELECT 0 AS grp, * FROM lab), {_FOLDS.format(k=5, trials=1)}\n"
# the five metrics of each group of predictions
_SCORES = """r AS (SELECT *, rank() OVER (PARTITION BY grp, n_trial, fold ORDER BY {s}) + (count(*) OVER (PARTITION BY grp, n_trial, fold, {s}) - 1) / 2.0::DOUBLE AS rk FROM p),
c AS (SELECT grp, n_trial, fold, count(*) AS n, sum((label = prediction)::INT) AS ok, sum((label = 1 AND prediction = 1)::INT) AS tp,
  sum(prediction) AS pp, sum((label = 1)::INT)::DOUBLE AS ap, sum((label <> 1)::INT)::DOUBLE AS an, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r GROUP BY ALL),
sc AS (SELECT grp, n_trial, fold, n, ok / n AS accuracy, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS precision, CASE WHEN ap = 0 THEN 0 ELSE tp / ap END AS recall,
  CASE WHEN 2 * tp + (pp - tp) + (ap - tp) = 0 THEN 0 ELSE 2 * tp / (pp + ap) END AS f1,
  CASE WHEN ap > 0 AND an > 0 THEN (rs - ap * (ap + 1) / 2) / (ap * an) END AS roc_auc FROM c)"""
_ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in EX.METRICS)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in EX.METRICS else F.col(c) for c in df.columns])


def _labelled(spark, sf):
    return views.labelled(spark, sf).select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"), "label")


def _predictions(spark, sf, trials, k):
    path = scratch_path(spark, f"experiments/{uuid.uuid4().hex}")
    return EX.predict_folds(_labelled(spark, sf).drop("text"), lambda _: EX.NearestMean("n_chars"), path, trials, k)


def _explored(spark, sf):
    return EX.explored(_predictions(spark, sf, 1, 5), _labelled(spark, sf))


@query("explore_predictions", _ONE + "SELECT doc_id, label::BIGINT AS label, prediction::BIGINT AS prediction, round(score, 6) AS score, fold FROM p")
def explore_predictions(spark, sf):
    """Out-of-fold predictions of five stratified folds."""
    return _predictions(spark, sf, 1, 5).select("doc_id", "label", "prediction", F.round("score", 6).alias("score"), "fold")


@query("explore_matrix", _ONE + "SELECT label::BIGINT AS label, prediction::BIGINT AS prediction, count(*) AS n FROM p GROUP BY ALL")
def explore_matrix(spark, sf):
    return _explored(spark, sf)["matrix"]


@query("explore_report", _ONE + """, t AS (SELECT label AS c, count(*) AS support, sum((label = prediction)::INT) AS tp FROM p GROUP BY label),
q AS (SELECT prediction AS c, count(*) AS npred FROM p GROUP BY prediction),
mm AS (SELECT coalesce(t.c, q.c)::VARCHAR AS class, CASE WHEN coalesce(npred, 0) = 0 THEN 0 ELSE coalesce(tp, 0) / npred END AS precision,
  CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE tp / support END AS recall, coalesce(support, 0) AS support FROM t FULL JOIN q ON t.c = q.c),
g AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM mm)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM g
UNION ALL SELECT 'avg / total', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM g""")
def explore_report(spark, sf):
    return _rounded(_explored(spark, sf)["report"])


@query("explore_false_positives", _ONE + "SELECT DISTINCT doc_id, text FROM p WHERE label = 0 AND prediction = 1")
def explore_false_positives(spark, sf):
    return _explored(spark, sf)["false_positives"]


@query("explore_false_negatives", _ONE + "SELECT DISTINCT doc_id, text FROM p WHERE label = 1 AND prediction = 0")
def explore_false_negatives(spark, sf):
    return _explored(spark, sf)["false_negatives"]


_CV = f"WITH {_LAB}, data AS (SELECT 0 AS grp, * FROM lab), {_FOLDS.format(k=3, trials=10)}, "


@query("cv_direct_scores", _CV + _SCORES.format(s="prediction") + f" SELECT n_trial, fold, n, {_ROUND} FROM sc")
def cv_direct_scores(spark, sf):
    """Ten trials of three folds; the area taken from the hard predictions."""
    return _rounded(EX.fold_scores(_predictions(spark, sf, 10, 3), direct=True).drop("name"))


@query("cv_mean_scores", _CV + _SCORES.format(s="score") + " SELECT count(DISTINCT n_trial) AS n_trials, count(*) AS n_fits, "
       + ", ".join(f"round(avg({m}), 6) AS {m}" for m in EX.METRICS) + " FROM sc")
def cv_mean_scores(spark, sf):
    """Mean over folds and trials of the five metrics."""
    return _rounded(EX.mean_over_fits(EX.fold_scores(_predictions(spark, sf, 10, 3)), []))


@query("label_split", """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('2:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents),
rest AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM o WHERE r > ceil(n * 0.3::DOUBLE))
SELECT doc_id, 'labelled' AS part FROM o WHERE r <= ceil(n * 0.3::DOUBLE)
UNION ALL SELECT doc_id, CASE WHEN r <= ceil(n * 0.4::DOUBLE) THEN 'unlabelled' ELSE 'unused' END FROM rest""")
def label_split(spark, sf):
    """A labelled share, and of the others a share that serves unlabelled."""
    return EX.label_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.3, 0.4, trial=2)


# the grid: shares of labelled rows, shares of the others, trials
_P, _THRESH, _TRIALS = (0.3, 0.6, 1.0), (0.0, 0.5), range(5)
_GRID = ("g AS (SELECT row_number() OVER () AS grp, * FROM (SELECT unnest([" + ", ".join(f"{p}::DOUBLE" for p in _P) + "]) AS p), (SELECT unnest(["
         + ", ".join(f"{t}::DOUBLE" for t in _THRESH) + "]) AS thresh), range(5) r(trial))")


@query("label_sweep", f"""WITH {_LAB}, {_GRID},
o AS (SELECT g.*, lab.*, row_number() OVER (PARTITION BY grp ORDER BY md5(trial || ':' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY grp) AS total FROM g, lab),
data AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n_rows FROM o WHERE r <= ceil(total * p)), {_FOLDS.format(k=3, trials=1)}, {_SCORES.format(s="score")},
w AS (SELECT DISTINCT grp, n_rows FROM data)
SELECT trial::INT AS n_trial, fold::INT AS i, 'length' AS name, -1 AS size, p, thresh, n_rows::INT AS n_rows, round(n_rows * (p + thresh - p * thresh), 6) AS corpus_size,
  {_ROUND}, -1 AS n_components, 'mean' AS clf_base
FROM sc JOIN g USING (grp) JOIN w USING (grp)""")
def label_sweep(spark, sf):
    """The score log of a sweep over shares and trials: on each labelled subset
    three stratified folds."""
    data = _labelled(spark, sf).drop("text").persist()

    done: dict = {}  # the scores do not depend on the share of the others

    def run(g):
        key = g["p"], g["n_trial"]
        if key not in done:
            part = EX.label_split(data, "doc_id", g["p"], 0, g["n_trial"]).where("part = 'labelled'").drop("part")
            path = scratch_path(spark, f"experiments/{uuid.uuid4().hex}")
            p = EX.predict_folds(part, lambda _: EX.NearestMean("n_chars"), path, 1, 3, {"length": None}, at_once=3)
            scores = EX.fold_scores(p)
            done[key] = scores.schema, scores.collect()  # a row a fold
        schema, rows = done[key]
        return EX.log_rows(spark.createDataFrame(rows, schema), g, sum(r.n for r in rows))

    grid = [{"p": p, "thresh": t, "n_trial": n, "clf_base": "mean"} for p in _P for t in _THRESH for n in _TRIALS]
    grid.sort(key=lambda g: g["thresh"])
    log = EX.sweep(spark, grid, run, scratch_path(spark, f"sweep-{uuid.uuid4().hex}"))
    data.unpersist()
    return _rounded(log.withColumn("corpus_size", F.round("corpus_size", 6)))


_TV = ("tv AS (SELECT vec_id // 10 AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings)")


@query("feature_slices", f"""WITH {_TV}, d AS (SELECT doc_id, unnest(range(len(v)))::BIGINT AS dim, unnest(v) AS y,
  unnest(list_transform(v, lambda x, j: x - v[((j - 2) % len(v) + len(v)) % len(v) + 1])) AS x FROM tv)
SELECT doc_id, dim, round(stddev_pop(y), 6) AS value FROM d GROUP BY doc_id, dim
UNION ALL SELECT doc_id, dim + 64, round(median(x), 6) FROM d GROUP BY doc_id, dim""")
def feature_slices(spark, sf):
    """The columns of two blocks (deviations, first difference) cut out of the
    feature array by their coordinates."""
    at = block_coordinates(64, 1, 2)
    rows = feature_rows(message_vector_blocks(views.token_vectors(spark, sf), d0=1, d1=2))
    cut = rows.select("doc_id", feature_slice("features", at["01_std"][0], at["02_diff1_1"][1]).alias("c"))
    return cut.select("doc_id", F.posexplode("c").alias("dim", "value")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))
