"""Model fitting at the ML boundary: word2vec, LDA, Gaussian mixtures, PCA,
TF-IDF feature vectors and repeated stratified cross-validation.

Estimators are Spark ML's (distributed fits); this module builds their
inputs from DataFrames and turns their outputs back into tables.  Results
differ numerically from other libraries' solvers (see README).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import LDA, GaussianMixture
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators import experiments as EX
from murmur.operators import metrics as M
from murmur.operators import skipgram as SG
from murmur.operators.sampling import stratified_folds
from murmur.operators.vocab import doc2bow, tfidf, tokens_long
from murmur.session import scratch_path, small_batches


def _fit_layout(data: DataFrame) -> tuple[DataFrame, int]:
    """The data persisted for an iterative solver, and its rows (the solver's
    regularisation is a share of them).  The layout is the same at every size."""
    data = data.persist()
    return data, data.count()


# ---- word vectors -----------------------------------------------------------

def train_word2vec(docs: DataFrame, size: int = 100, window: int = 10, min_count: int = 2,
                   max_iter: int = 20, step: float = 0.05, seed: int = 1, partitions: int | None = None,
                   tokens_col: str = "tokens") -> SG.SkipGramModel:
    """Skip-gram with hierarchical softmax over all occurrences, ``max_iter``
    epochs on as many partitions as the cluster runs at once, whose models are
    averaged after each (as Spark's Word2Vec does, whose bound on the vocabulary
    holds).  Messages are never cut; each row is a message, whatever its id."""
    partitions = partitions or docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), tokens_col)
    trainer = SG.SkipGram(size=size, window=window, min_count=min_count, epochs=max_iter, step=step, least_step=step * 1e-4, sample=0, seed=seed,
                          partitions=partitions, shuffle=False, bound=8 * (2 ** 31 - 1))
    return trainer.fit(rows, "_row", tokens_col)


def word_vectors(model: SG.SkipGramModel) -> DataFrame:
    """``(word, vector array<double>)``, each vector unit-normalised."""
    return model.table(SparkSession.active())


# ---- bag-of-words vectors -----------------------------------------------------

def sparse_vectors(docs: DataFrame, cells: DataFrame, size: int, value: str, id_col: str = "doc_id",
                   out: str = "features") -> DataFrame:
    """``(doc_id, features)`` of every row of ``docs`` from ``(doc_id, token_id,
    value)`` rows: vectors of ``size`` entries, without entries where a document
    has no row.  Only a document's own cells meet in a task; the vocabulary goes
    nowhere as a whole."""
    small_batches(docs.sparkSession)
    packed = (cells.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("token_id").cast("int").alias("i"), F.col(value).cast("double").alias("v")))).alias("_c"))
              .select(id_col, F.col("_c.i").alias("_i"), F.col("_c.v").alias("_v")))
    rows = docs.select(id_col).join(packed, id_col, "left").select(id_col, F.coalesce("_i", F.array().cast("array<int>")).alias("_i"),
                                                                   F.coalesce("_v", F.array().cast("array<double>")).alias("_v"))

    def run(batches):
        for b in batches:  # the columns as they are, under the vector type's names
            n = b.num_rows
            sparse = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), b.column("_i"), b.column("_v")],
                                                ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column(id_col), sparse], [id_col, out])

    return rows.mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField(out, VectorUDT())]))


def count_vectors(docs: DataFrame, bow: DataFrame, kept: DataFrame) -> DataFrame:
    """Sparse vectors of token counts over the kept vocabulary."""
    return sparse_vectors(docs, doc2bow(bow, kept), kept.count(), "tf")


def tfidf_vectors(docs: DataFrame, bow: DataFrame, kept: DataFrame, n_docs: int) -> DataFrame:
    """Sparse TF-IDF vectors (``tf * log2(N/df)``, L2-normalised) over the kept
    vocabulary."""
    return sparse_vectors(docs, tfidf(bow, kept, n_docs), kept.count(), "weight")


# ---- topics ---------------------------------------------------------------------

def fit_lda(features: DataFrame, k: int = 10, max_iter: int = 5, seed: int = 1,
            features_col: str = "features"):
    """Online variational LDA: decay 0.5, eta 0.1, document concentration
    optimised (asymmetric alpha).  Each iteration is a pass over all messages."""
    lda = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online", learningDecay=0.5,
              topicConcentration=0.1, optimizeDocConcentration=True, subsamplingRate=1.0, featuresCol=features_col,
              topicDistributionCol="topicDistribution")
    return lda.fit(features)


def topic_definitions(model, vocab: DataFrame, n: int = 20) -> DataFrame:
    """``(topic, rank, word, weight)``: the ``n`` top words of each topic."""
    d = model.describeTopics(n)
    rows = d.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    rows = rows.select("topic", (F.col("rank") + 1).cast("long").alias("rank"),
                       F.col("t.termIndices").cast("long").alias("token_id"), F.col("t.termWeights").alias("weight"))
    # the top words are the bounded side, the vocabulary is not
    return vocab.select("token_id", F.col("token").alias("word")).join(F.broadcast(rows), "token_id") \
        .select("topic", "rank", "word", "weight")


def doc_topic_weights(model, features: DataFrame, id_col: str = "doc_id", min_prob: float = 0.01) -> DataFrame:
    """``(doc_id, topic, weight)`` with topics below ``min_prob`` omitted."""
    t = model.transform(features).select(id_col, vector_to_array("topicDistribution").alias("_d"))
    t = t.select(id_col, F.posexplode("_d").alias("topic", "weight"))
    return t.filter(F.col("weight") >= min_prob)


def topic_labels(defs: DataFrame, by: str = "word") -> DataFrame:
    """``(topic, label)``: a topic's words space-joined, in the order of the
    words, or heaviest first (``by="weight"``, ties by word)."""
    if by == "word":
        return defs.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("label"))
    cells = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "word")))
    return defs.groupBy("topic").agg(F.array_join(F.transform(cells, lambda c: c["word"]), " ").alias("label"))


# ---- clusters ---------------------------------------------------------------------

def fit_gmm(vectors: DataFrame, k: int, seed: int = 1, vec_col: str = "vector", max_iter: int = 100,
            tol: float = 1e-4):
    """Finite Gaussian mixture (full covariance) - stands in for the
    Dirichlet-process mixture (see README)."""
    data = vectors.withColumn("_f", array_to_vector(vec_col))
    return GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="_f",
                           predictionCol="cluster", probabilityCol="_p").fit(data)


def assign_clusters(model, vectors: DataFrame, vec_col: str = "vector") -> DataFrame:
    data = vectors.withColumn("_f", array_to_vector(vec_col))
    return model.transform(data).drop("_f", "_p")


def recluster(assigned: DataFrame, k: int, thresh: int, seed: int = 1, vec_col: str = "vector") -> DataFrame:
    """Re-cluster the members of clusters larger than ``thresh`` with
    ``k // 2`` components each; ``subcluster`` is null for the others."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    big = [r["cluster"] for r in sizes.filter(F.col("_n") > thresh).collect()]  # at most k ids
    out = assigned.filter(~F.col("cluster").isin(big)).withColumn("subcluster", F.lit(None).cast("int"))
    for c in big:
        part = assigned.filter(F.col("cluster") == c).drop("cluster")
        sub = assign_clusters(fit_gmm(part, max(1, k // 2), seed, vec_col), part, vec_col)
        out = out.unionByName(sub.withColumnRenamed("cluster", "subcluster").withColumn("cluster", F.lit(c)))
    return out


def pca_2d(vectors: DataFrame, vec_col: str = "vector", k: int = 2) -> DataFrame:
    data = vectors.withColumn("_f", array_to_vector(vec_col))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(data)
    out = model.transform(data).withColumn("_a", vector_to_array("_p"))
    return out.select(*[c for c in vectors.columns if c != vec_col],
                      F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"))


# ---- classifiers and cross-validation --------------------------------------------

def classifier(name: str = "lr", n_train: int = 1, c: float = 1.0):
    """``lr`` (logistic), ``sgd`` (logistic, L2 0.005), ``svc`` (linear SVM);
    ``regParam = 1 / (C * n)`` mirrors the C parameterisation."""
    if name == "svc":
        return LinearSVC(regParam=1.0 / (c * max(n_train, 1)), maxIter=100, standardization=False)
    if name == "sgd":
        return LogisticRegression(regParam=0.005, elasticNetParam=0.0, maxIter=5, standardization=False)
    return LogisticRegression(regParam=1.0 / (c * max(n_train, 1)), maxIter=100, standardization=False)


def _fold_scores(pred: DataFrame, label: str) -> dict:
    m = M.binary_metrics(pred, label, "prediction").first()
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                        metricName="areaUnderROC", numBins=0).evaluate(pred)  # 0: exact
    return {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"],
            "f1": m["f1"], "roc_auc": auc}


def _folded(data: DataFrame, label: str, id_col: str, k: int, seed: int) -> DataFrame:
    """``data`` with its stratified fold; only ids and labels pass through the
    ordered scan, the features are joined back."""
    folds = stratified_folds(data.select(id_col, label), label, id_col, k, seed=seed)
    return data.join(folds.select(id_col, "fold"), id_col)


def cv_predictions(data: DataFrame, clf_name: str = "lr", n_trials: int = 10, n_cv: int = 3, label: str = "label", id_col: str = "doc_id",
                   c: float = 1.0, sets: dict | None = None, path: str | None = None) -> DataFrame:
    """Out-of-fold predictions of repeated stratified k-fold fits, saved at
    ``path`` (see :mod:`murmur.operators.experiments`)."""
    path = path or scratch_path(data.sparkSession, f"experiments/{uuid.uuid4().hex}")
    make = lambda n: classifier(clf_name, n, c).setLabelCol(label).setFeaturesCol("features")
    return EX.predict_folds(data, make, path, n_trials, n_cv, sets, label, id_col)


def cv_scores(data: DataFrame, clf_name: str = "lr", n_trials: int = 10, n_cv: int = 3,
              label: str = "label", id_col: str = "doc_id", c: float = 1.0, direct: bool = False) -> DataFrame:
    """Repeated stratified k-fold: ``(n_trial, fold, accuracy, precision,
    recall, f1, roc_auc, iterations, converged)``, the last two telling how the
    solver stopped.  ``direct`` takes the area from the hard predictions."""
    p = cv_predictions(data, clf_name, n_trials, n_cv, label, id_col, c)
    stopped = p.groupBy("n_trial", "fold").agg(F.max("iterations").alias("iterations"), F.max("converged").alias("converged"))
    return EX.fold_scores(p, direct).select("n_trial", "fold", *EX.METRICS).join(stopped, ["n_trial", "fold"])


def mean_scores(scores: DataFrame) -> DataFrame:
    """One row: each metric's mean over folds and trials, and how many there were."""
    return EX.mean_over_fits(scores, [])


def out_of_fold(data: DataFrame, clf_name: str = "lr", n_cv: int = 5, label: str = "label",
                id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, label, prediction)`` where every row is predicted by the
    model of the fold that left it out."""
    return cv_predictions(data, clf_name, 1, n_cv, label, id_col).select(id_col, "label", "prediction")


def grid_search(data: DataFrame, reg_params=(0.001, 0.01, 0.1, 1.0), n_cv: int = 2, label: str = "label",
                seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """``(reg_param, accuracy, best)``: cross-validated accuracy per setting over
    stratified folds; ``best`` marks the setting that wins."""
    data, _ = _fit_layout(data.withColumn(label, F.col(label).cast("double")))
    folded, _, cached = EX.laid_out(_folded(data, label, id_col, n_cv, seed).withColumn("fold", F.col("fold").cast("int")))
    lr = LogisticRegression(maxIter=100, standardization=False, labelCol=label, featuresCol="features")
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    cvm = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, numFolds=n_cv,
                         seed=seed, parallelism=EX.side_by_side(EX.feature_width(folded), 4), foldCol="fold").fit(folded)
    best = max(cvm.avgMetrics)
    cached.unpersist()
    data.unpersist()
    won = next(i for i, m in enumerate(cvm.avgMetrics) if m == best)
    rows = [(float(g[lr.regParam]), float(m), i == won) for i, (g, m) in enumerate(zip(grid, cvm.avgMetrics))]
    return data.sparkSession.createDataFrame(rows, "reg_param double, accuracy double, best boolean")


def train_test_scores(data: DataFrame, clf_name: str = "lr", p: float = 0.8, seed: int = 0,
                      label: str = "label", id_col: str = "doc_id") -> DataFrame:
    """One seeded exact split, one distributed fit, five test metrics."""
    from murmur.operators.sampling import exact_split
    data, _ = _fit_layout(data.withColumn(label, F.col(label).cast("double")))
    # only ids pass through the ordered scan; features are joined back
    split = data.join(exact_split(data.select(id_col), id_col, p, seed), id_col).persist()
    train = split.filter(F.col("in_sample"))
    test = split.filter(~F.col("in_sample"))
    n = train.count()
    tasks = EX.task_count(split, int(str(split._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))  # cached, so known
    model = classifier(clf_name, n).setLabelCol(label).setFeaturesCol("features").fit(train.coalesce(tasks))
    s = _fold_scores(model.transform(test), label)
    split.unpersist()
    data.unpersist()
    return data.sparkSession.createDataFrame([s], "accuracy double, precision double, recall double, "
                                                  "f1 double, roc_auc double")


def cluster_vocabulary(kept: DataFrame, vectors: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """Words eligible for clustering: in the kept vocabulary, longer than one
    character, with a vector, not a stop word; ``(word, vector)``.  The kept
    vocabulary is bounded by ``keep_n`` and is the broadcast side."""
    v = kept.select(F.col("token").alias("word")).filter(F.length("word") > 1)
    if stopwords:
        v = v.filter(~F.col("word").isin(list(stopwords)))
    return vectors.join(F.broadcast(v), "word")


def doc_cluster_counts(tokens_long: DataFrame, assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, cluster, n)``: how many of a message's words fall in each
    cluster (words without a cluster are skipped)."""
    return (tokens_long.join(assigned.select(F.col("word").alias("token"), "cluster"), "token")
            .groupBy(id_col, "cluster").agg(F.count(F.lit(1)).alias("n")))


def doc_mean_vectors(model: SG.SkipGramModel, docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Message vector as the mean of its words' vectors: the sum of those that are
    known over the number of words, zeros without a known word."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), id_col, tokens_col)
    size = model.size
    known = tokens_long(rows, "_row", tokens_col).select("_row", F.col("token").alias("word")).join(
        model.table(docs.sparkSession, scaled=False), "word")
    sums = known.groupBy("_row").agg(vector_to_array(Summarizer.sum(array_to_vector("vector"))).alias("_s"))
    mean = F.transform(F.coalesce("_s", F.array_repeat(F.lit(0.0), size)), lambda x: x / F.greatest(F.size(tokens_col), F.lit(1)))
    return rows.join(sums, "_row", "left").select(id_col, mean.alias("vector"))
