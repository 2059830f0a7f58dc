"""Repeated stratified experiments from one table of out-of-fold predictions.

Folds of all trials come from a single ordered scan.  Every fit writes what it
predicts for the rows it left out to one table, ``(name, n_trial, fold, id, label,
prediction, score, iterations, converged)``; scores, the confusion matrix, the
report and the misclassified rows are read from that table, in one pass for all
fits, and a run that is repeated reads the fits that are there.

A classifier is anything with ``fit(train)`` that returns something with
``transform(test)`` adding ``prediction``: Spark ML estimators, or
:class:`NearestMean`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators.ordered import ordered_scan, scans_released
from murmur.operators.sampling import seeded_key

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
#: Bytes of cached rows that a task of a solver's pass reads.
TASK_BYTES = 64 << 20
#: Numbers that solvers side by side hold on the driver, and vectors as long as the
#: features that one of them holds (its memory of steps, gradients, weights).
SOLVER_NUMBERS, SOLVER_VECTORS = 1 << 24, 25


# ---- folds and splits ---------------------------------------------------------------

def trial_folds(rows: DataFrame, label: str, id_col: str, k: int, trials: int) -> DataFrame:
    """``(id, folds array<long>)``: the stratified fold of each row in each
    trial.  The order of a trial is seeded by its number; one ordered scan
    serves all of them."""
    many = rows.select(id_col, label).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    key = F.md5(F.concat(F.col("_t").cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    scan = ordered_scan(many.withColumn("_k", key), ["_t", label, "_k", id_col])
    first = scan.groupBy("_t", label).agg(F.min("_i").alias("_f"))
    folds = scan.join(F.broadcast(first), ["_t", label]).select(id_col, "_t", ((F.col("_i") - F.col("_f")) % k).alias("_fold"))
    return folds.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_fold"))), lambda x: x["_fold"]).alias("folds"))


def label_split(df: DataFrame, id_col: str, p: float, thresh: float, trial: int = 0, part: str = "part") -> DataFrame:
    """``df`` with ``part``: ``labelled`` for the first ``ceil(p * N)`` rows of the
    trial's seeded order (so a smaller ``p`` gives a subset of a larger one),
    ``unlabelled`` for ``ceil(thresh * M)`` of the ``M`` others (in an order of its
    own, the same in all trials), ``unused`` for the rest."""
    def counted(rows: DataFrame, share: float, seed: int, yes: str, no: str) -> DataFrame:
        if share >= 1 or share <= 0:
            return rows.withColumn(part, F.lit(yes if share >= 1 else no))
        n = rows.select(F.count(F.lit(1))).scalar()
        scan = ordered_scan(rows.withColumn("_k", seeded_key(id_col, seed)), ["_k", id_col])
        return scan.withColumn(part, F.when(F.col("_i") < F.ceil(n * F.lit(float(share))), yes).otherwise(no)).drop("_i", "_k")

    ids = counted(df.select(id_col), p, trial, "labelled", "rest")
    rest = counted(ids.where(F.col(part) == "rest").select(id_col), thresh, 0, "unlabelled", "unused")
    return df.join(ids.where(F.col(part) == "labelled").unionByName(rest), id_col)


# ---- classifiers ----------------------------------------------------------------------

class NearestMean:
    """Predicts the class whose mean of one number is nearer (ties: class 1); the
    score is how much nearer the mean of class 1 is."""

    def __init__(self, column: str, label: str = "label"):
        self.column, self.label = column, label

    def fit(self, train: DataFrame) -> "NearestMean":
        out = NearestMean(self.column, self.label)
        of = lambda k: F.avg(F.when(F.col(self.label) == k, F.col(self.column)))
        out.means = train.agg(of(0).alias("a"), of(1).alias("b")).first()
        return out

    def transform(self, test: DataFrame) -> DataFrame:
        a, b = (F.lit(x).cast("double") for x in (self.means.a, self.means.b))
        x = F.col(self.column).cast("double")
        score = F.when(a.isNull(), 1.0).when(b.isNull(), -1.0).otherwise(F.abs(x - a) - F.abs(x - b))
        return test.withColumn("score", score).withColumn("prediction", F.when(score >= 0, 1.0).otherwise(0.0))


def side_by_side(width: int, most: int) -> int:
    """How many solvers over ``width`` features may go on at once, ``most`` at most."""
    return max(1, min(most, SOLVER_NUMBERS // (SOLVER_VECTORS * max(1, width))))


def feature_width(data: DataFrame, column: str = "features") -> int:
    """Entries of a row's vector (0 without rows, or without such a column)."""
    row = data.select(column).where(F.col(column).isNotNull()).first() if column in data.columns else None
    return len(row[0]) if row is not None else 0


def task_count(data: DataFrame, size: int) -> int:
    """Tasks of a solver's pass over ``size`` bytes: each sends sums as wide as the
    features in every pass, so there are never more than run at once."""
    return max(1, min(-(-size // TASK_BYTES), data.sparkSession.sparkContext.defaultParallelism))


def laid_out(data: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """The data cached in tasks of about ``TASK_BYTES``, its rows, and what is to
    be unpersisted in the end.  A solver
    passes over it up to a hundred times, so many small tasks cost more than
    they save; the rule is the same at every size."""
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    n = data.count()
    size = int(str(data._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # known exactly, as it is cached
    return data.coalesce(task_count(data, size)), n, data


def saved_with_folds(data: DataFrame, label: str, id_col: str, k: int, trials: int, path: str) -> DataFrame:
    """``data`` with its folds (see :func:`trial_folds`), written under ``path``
    and read back: hundreds of fits then start from a short plan, the scan behind
    the folds is released, and a lost executor reads rows again."""
    where = f"{path}/data/{uuid.uuid4().hex}"
    with scans_released():
        rows = data.join(trial_folds(data.select(id_col, label), label, id_col, k, trials), id_col)
        rows.write.parquet(where)
    return data.sparkSession.read.schema(rows.schema).parquet(where)


# ---- predictions -------------------------------------------------------------------------

@dataclass(frozen=True)
class Fit:
    """One fit: a feature set's name, a trial and the fold that is left out."""

    name: str
    n_trial: int
    fold: int


def summary_of(model) -> tuple[int | None, bool | None]:
    """Iterations of the solver, and whether it stopped by itself."""
    if not getattr(model, "hasSummary", False):
        return None, None
    summary = model.summary() if callable(model.summary) else model.summary  # a method of some models
    done = int(summary.totalIterations)
    return done, done < model.getMaxIter()


def finished(spark: SparkSession, path: str, wanted: list[Fit]) -> set[Fit]:
    """Those of the fits whose predictions are at ``path``: written to the end
    (the writer's mark is there), or published as a group."""
    fs = spark._jvm.org.apache.hadoop.fs
    mark = lambda f: fs.Path(f"{folder(path, f)}/_SUCCESS")
    there = {f for f in wanted if mark(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark(f))}
    try:
        rows = (spark.read.schema("name string, n_trial long, fold long").option("recursiveFileLookup", True).json(f"{path}/fits")
                .distinct().collect())  # a row a fit
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return there | {Fit(r.name, r.n_trial, r.fold) for r in rows} & set(wanted)


def predict_folds(data: DataFrame, classifier: Callable[[int], object], path: str, n_trials: int, n_cv: int, sets: dict[str, Column | None] | None = None,
                  label: str = "label", id_col: str = "doc_id", at_once: int = 8) -> DataFrame:
    """The table of out-of-fold predictions at ``path``; fits that are not there
    are made, ``at_once`` side by side, each a distributed one.

    ``classifier(rows)`` makes an estimator for so many training rows.  ``sets``
    names feature sets, each a column expression that becomes ``features`` (None:
    the data as it is); all sets share the folds."""
    spark = data.sparkSession
    sets = sets or {"all": None}
    wanted = [Fit(s, t, f) for t in range(n_trials) for f in range(n_cv) for s in sets]
    there = finished(spark, path, wanted)
    left = [w for w in wanted if w not in there]
    if left:
        data = data.withColumn(label, F.col(label).cast("double"))
        rows, n, cached = laid_out(saved_with_folds(data, label, id_col, n_cv, n_trials, path))

        def run(fit: Fit) -> None:
            fold = F.get("folds", F.lit(fit.n_trial))
            some = rows if sets[fit.name] is None else rows.withColumn("features", sets[fit.name])
            model = classifier(n * (n_cv - 1) // n_cv).fit(some.where(fold != fit.fold))
            out = model.transform(some.where(fold == fit.fold))
            if "score" in out.columns:
                score = F.col("score")
            elif "rawPrediction" in out.columns:
                score = vector_to_array("rawPrediction")[1]
            else:
                score = F.col("prediction")
            iterations, converged = summary_of(model)
            (out.select(id_col, F.col(label).cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"), score.cast("double").alias("score"))
             .withColumn("iterations", F.lit(iterations).cast("long")).withColumn("converged", F.lit(converged).cast("boolean"))
             .write.mode("overwrite").parquet(folder(path, fit)))

        with ThreadPoolExecutor(max_workers=side_by_side(feature_width(rows), at_once)) as pool:
            list(pool.map(run, left))
        cached.unpersist()
    schema = T.StructType([T.StructField(id_col, data.schema[id_col].dataType), *T.StructType.fromDDL(
        "label long, prediction long, score double, iterations long, converged boolean, name string, n_trial long, fold long").fields])
    table = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return table.where(F.col("n_trial") < n_trials).where(F.col("fold") < n_cv).where(F.col("name").isin(list(sets)))


def folder(path: str, fit: Fit) -> str:
    return f"{path}/rows/name={fit.name}/n_trial={fit.n_trial}/fold={fit.fold}"


# ---- what is read from them ----------------------------------------------------------------

def grouped_auc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """``(keys, roc_auc)``: the exact rank-sum area of each group (ties get mean
    ranks; null where a class is missing).  Distinct scores are counted first;
    one ordered scan over all groups gives the ranks."""
    g = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("_np"))
    scan = ordered_scan(g, [*keys, "_s"], value="_n", op="sum", acc_col="_cum")
    base = scan.groupBy(*keys).agg(F.min(F.col("_cum") - F.col("_n")).alias("_base"))
    rank = F.col("_cum") - F.col("_base") - (F.col("_n") - 1) / 2
    s = scan.join(base, keys).groupBy(*keys).agg(F.sum(F.col("_np") * rank).alias("_r"), F.sum("_np").alias("_p"), F.sum(F.col("_n") - F.col("_np")).alias("_q"))
    area = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))
    return s.select(*keys, F.when((F.col("_p") > 0) & (F.col("_q") > 0), area).alias("roc_auc"))


def fold_scores(predictions: DataFrame, direct: bool = False, keys: tuple[str, ...] = ("name", "n_trial", "fold")) -> DataFrame:
    """The five metrics of every fit.  ``direct`` takes the area from the hard
    predictions instead of the scores."""
    from murmur.operators.metrics import binary_metrics
    keys = list(keys)
    area = grouped_auc(predictions, keys, score="prediction" if direct else "score")
    return binary_metrics(predictions, keys=keys).join(area, keys).select(*keys, "n", *METRICS)


def mean_over_fits(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Each metric's mean over folds and trials, and how many there were."""
    return scores.groupBy(*keys).agg(F.countDistinct("n_trial").alias("n_trials"), F.count(F.lit(1)).alias("n_fits"), *[F.avg(m).alias(m) for m in METRICS])


def explored(predictions: DataFrame, messages: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """What an exploration shows of saved predictions: ``matrix``, ``report``,
    and the messages (``id, text``, once each) that are ``false_positives``,
    ``false_negatives`` and ``positives``."""
    from murmur.operators.metrics import class_report, confusion
    wrong = F.col("label") != F.col("prediction")
    kinds = {"false_positives": wrong & (F.col("label") != 1), "false_negatives": wrong & (F.col("label") == 1), "positives": F.col("label") == 1}
    out = {"matrix": confusion(predictions), "report": class_report(predictions)}
    for name, which in kinds.items():
        ids = predictions.where(which).select(id_col).distinct()
        out[name] = messages.join(ids, id_col, "left_semi").select(id_col, "text")
    return out


def save_explored(parts: dict[str, DataFrame], base: str, id_col: str = "doc_id") -> None:
    """Misclassified and positive messages as CSV, the other parts as parquet."""
    from murmur.sources.io import write_csv
    for name, df in parts.items():
        if name in ("matrix", "report"):
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        else:
            write_csv(df.select(F.col(id_col).cast("string").alias("id_str"), "text"), f"{base}/{name}")


# ---- score log and sweeps --------------------------------------------------------------------

def log_rows(scores: DataFrame, setting: dict, n_rows: int, size: int = -1, n_components: int = -1) -> DataFrame:
    """Scores of fits as rows of the score log: ``n_trial`` is the setting's trial,
    ``i`` counts the fits from 0, ``corpus_size`` is the share of the corpus used."""
    from murmur.sources.io import SCORE_LOG_SCHEMA
    n_cv = F.col("_cv") + 1
    p, t = float(setting["p"]), float(setting["thresh"])
    values = {"n_trial": F.lit(setting["n_trial"]), "i": F.col("n_trial") * n_cv + F.col("fold"), "name": F.col("name"), "size": F.lit(size), "p": F.lit(p),
              "thresh": F.lit(t), "n_rows": F.lit(n_rows), "corpus_size": F.lit(n_rows * (p + t - p * t)), "n_components": F.lit(n_components),
              "clf_base": F.lit(setting["clf_base"]), **{m: F.col(m) for m in METRICS}}
    last = scores.agg(F.max("fold").alias("_cv"))  # one row
    return scores.crossJoin(F.broadcast(last)).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SCORE_LOG_SCHEMA])


def sweep(spark: SparkSession, grid: list[dict], run: Callable[[dict], DataFrame], path: str, at_once: int = 4) -> DataFrame:
    """The score log at ``path`` with all settings of ``grid``: those it does not
    hold are run (``run(setting)`` gives their log rows), ``at_once`` side by side,
    and appended, so a sweep that was cut short goes on where it stopped."""
    from murmur.sources.io import SCORE_LOG_SCHEMA
    keys = ["n_trial", "p", "thresh", "clf_base"]

    def log() -> DataFrame:
        return spark.read.schema(SCORE_LOG_SCHEMA).parquet(path)
    try:
        there = {tuple(r) for r in log().select(*keys).distinct().collect()}  # a row a setting
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = set()
    one = Lock()

    def add(setting: dict) -> None:
        with scans_released():
            rows = run(setting).collect()  # a row a fit
        with one:  # committed whole or not at all
            spark.createDataFrame(rows, SCORE_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)

    left = [g for g in grid if (g["n_trial"], float(g["p"]), float(g["thresh"]), g["clf_base"]) not in there]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        list(pool.map(add, left))
    return log()
