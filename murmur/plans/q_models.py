"""Step 10: models (row-count checks only, except the exact cluster counts
and topic vector sums)."""

from __future__ import annotations

import uuid

from pyspark.ml.clustering import LocalLDAModel
from pyspark.sql import functions as F

from murmur.operators import experiments as EX
from murmur.operators import lockstep as LS
from murmur.operators import mixture as MX
from murmur.operators import models as ML
from murmur.operators import phrases as P
from murmur.operators import skipgram as SG
from murmur.operators import timeline as TL
from murmur.operators import vocab as V
from murmur.operators.vectors import Standardizer, block_coordinates, feature_rows, message_vector_blocks
from murmur.plans import views
from murmur.plans.registry import query
from murmur.plans.sqlviews import TOKENS
from murmur.session import scratch_path, table
from murmur.sources.store import content_mark, stored

T2024_US = 1704067200000000


def _lda_inputs(spark, sf, phrases=False):
    docs = views.doc_tokens(spark, sf)
    if phrases:
        docs = P.process_text(docs).persist()
    bow = V.bag_of_words(docs).persist()  # the vocabulary, its order and the vectors all read it
    kept = V.filter_extremes(V.vocabulary(bow), V.count_docs(docs), 10, 0.8).checkpoint()
    return ML.count_vectors(docs, bow, kept), kept


def _lda(spark, sf, phrases=False):
    feats, kept = _lda_inputs(spark, sf, phrases)
    feats = feats.persist()
    params = {"k": 10, "max_iter": 5, "seed": 1}
    # the vectors' size and cells depend on the text rules and the vocabulary's bounds
    mark = content_mark(views.doc_tokens(spark, sf), "doc_id", "tokens")
    model = stored(spark, "lda", params | {"no_below": 10, "no_above": 0.8, "phrases": phrases, "mark": mark}, LocalLDAModel.load, lambda: ML.fit_lda(feats, **params))
    return model, feats, kept


def _w2v(spark, sf):
    """Tokens and the word2vec model of the documents (size 100, window 10, 20
    epochs), fitted once for these tokens and parameters and loaded by every later query."""
    docs = views.doc_tokens(spark, sf)
    params = {"size": 100, "window": 10, "min_count": 2, "max_iter": 20, "step": 0.05, "seed": 1}
    key = params | {"mark": content_mark(docs, "doc_id", "tokens"), "partitions": spark.sparkContext.defaultParallelism}
    return docs, stored(spark, "word_vectors", key, lambda p: SG.SkipGramModel.load(spark, p), lambda: ML.train_word2vec(docs, **params),
                        lambda m, p: m.save(spark, p))


@query("word2vec_fit")
def word2vec_fit(spark, sf):
    wv = ML.word_vectors(_w2v(spark, sf)[1])
    return wv.select("word", F.size("vector").cast("long").alias("dims"),
                     F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query("lda_topics")
def lda_topics(spark, sf):
    model, _, kept = _lda(spark, sf)
    return ML.topic_definitions(model, kept, 20)


@query("doc_topics")
def doc_topics(spark, sf):
    model, feats, _ = _lda(spark, sf)
    return ML.doc_topic_weights(model, feats)


@query("lda_timeline")
def lda_timeline(spark, sf):
    """Topics over time end to end: tokens, phrases, vocabulary, topics, weights
    of each message, time bins, and each topic's label."""
    model, feats, kept = _lda(spark, sf, phrases=True)
    dt = ML.doc_topic_weights(model, feats)
    dated = views.documents(spark, sf).select(
        "doc_id", F.timestamp_micros(F.lit(T2024_US) + F.col("doc_id") * 60_000_000).alias("ts"))
    binned = TL.with_lagged_bins(dated, "ts", "doc_id")
    hist = TL.topic_histogram(dt.join(binned, "doc_id")).select("topic", "bin", "bin_low_us", "weight")
    return hist.join(ML.topic_labels(ML.topic_definitions(model, kept, 20)), "topic")


def _scaled_words(spark, sf):
    wv = views.word_vectors(spark, sf)
    return Standardizer.fit(wv, "vector").transform(wv, "vector")


@query("gmm_clusters")
def gmm_clusters(spark, sf):
    w = _scaled_words(spark, sf)
    return ML.assign_clusters(ML.fit_gmm(w, k=10, seed=1), w).select("word", "cluster")


@query("recluster")
def recluster(spark, sf):
    w = _scaled_words(spark, sf)
    a = ML.assign_clusters(ML.fit_gmm(w, k=10, seed=1), w)
    return ML.recluster(a, k=10, thresh=60).select("word", "cluster", "subcluster")


@query("cluster_counts", "SELECT vec_id // 10 AS doc_id, label AS cluster, count(*) AS n FROM embeddings GROUP BY ALL")
def cluster_counts(spark, sf):
    emb = table(spark, sf, "embeddings")
    tw = emb.select(F.expr("vec_id div 10").alias("doc_id"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("token"))
    clusters = emb.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("label").alias("cluster"))
    return ML.doc_cluster_counts(tw, clusters)


@query("topic_vector_sum", """WITH e AS (SELECT label, unnest(range(len(embedding)))::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY 'w' || vec_id) AS r FROM embeddings) WHERE r <= 20)
SELECT label AS topic, dim, round(sum(x), 6) AS value FROM e GROUP BY ALL""")
def topic_vector_sum(spark, sf):
    from murmur.operators.topk import top_k_per_group
    emb = table(spark, sf, "embeddings").select("vec_id", "label", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                                                F.col("embedding").cast("array<double>").alias("v"))
    top = top_k_per_group(emb, ["label"], [F.col("word")], 20, salt_cols=["word"])
    cells = V.explode_positions(top.select("label", "v"), "label", "v", "dim", "x")
    return cells.groupBy(F.col("label").alias("topic"), "dim").agg(F.round(F.sum("x"), 6).alias("value"))


@query("pca_topics")
def pca_topics(spark, sf):
    s = topic_vector_sum(spark, sf)
    vecs = s.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_p")) \
        .select("topic", F.transform("_p", lambda x: x["value"]).alias("vector"))
    return ML.pca_2d(vecs, "vector")


def _bow_features(spark, sf):
    """TF-IDF vectors of the labelled rows.  Vocabulary and weights are fitted on all
    rows, as the reference does; a word that no labelled row holds would be a column
    of zeros, whose weight no solver moves from zero, and is not numbered."""
    docs = views.doc_tokens(spark, sf)
    bow = V.bag_of_words(docs).persist()
    n = views.documents(spark, sf).count()
    kept = V.filter_extremes(V.vocabulary(bow), n, views.BOW_NO_BELOW, views.BOW_NO_ABOVE)
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    mine = bow.join(lab, "doc_id", "left_semi")
    used = kept.join(mine.select("token").distinct(), "token", "left_semi").withColumnRenamed("token_id", "_all")
    used = V.with_row_index(used, ["_all"], "token_id").drop("_all").checkpoint()
    feats = ML.tfidf_vectors(docs.join(lab, "doc_id", "left_semi"), mine, used, n)
    return feats.join(lab, "doc_id").select("doc_id", "features", "label")


@query("cv_scores_lr")
def cv_scores_lr(spark, sf):
    return ML.cv_scores(_bow_features(spark, sf), "lr", n_trials=10, n_cv=3)


@query("cv_scores_svc")
def cv_scores_svc(spark, sf):
    return ML.cv_scores(_bow_features(spark, sf), "svc", n_trials=10, n_cv=3, c=10.0)


@query("grid_search")
def grid_search(spark, sf):
    return ML.grid_search(_bow_features(spark, sf))


@query("oof_predictions")
def oof_predictions(spark, sf):
    return ML.out_of_fold(_bow_features(spark, sf), "lr", n_cv=5)


def _message_blocks(spark, sf):
    docs, model = _w2v(spark, sf)
    wv = ML.word_vectors(model).checkpoint()
    toks = V.tokens_long(docs).withColumnRenamed("token", "word")
    tv = toks.join(wv, "word").select("doc_id", "pos", "vector")
    return message_vector_blocks(tv, docs.select("doc_id"), d0=1, d1=5, size=100)


@query("w2v_message_blocks")
def w2v_message_blocks(spark, sf):
    """Embedding features: word2vec on the messages, each message's known-word
    vectors, then the statistics blocks (M4)."""
    return _message_blocks(spark, sf)


@query("embedding_experiment")
def embedding_experiment(spark, sf):
    """Embedding classification end to end: word2vec, message blocks, scaler,
    nested feature sets, repeated stratified cross-validation; one row of mean
    scores per feature set, as the score log holds it."""
    blocks = _message_blocks(spark, sf)
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = feature_rows(blocks, out="x").join(lab, "doc_id").persist()
    feats = Standardizer.fit(rows, "x").transform(rows, "x")
    # set i holds the blocks up to i; all fits of all sets go on together
    at = block_coordinates(100, 1, 5)
    path = scratch_path(spark, f"experiments/{uuid.uuid4().hex}")
    predictions = LS.predict_folds_together(feats, {n: stop for n, (_, stop) in at.items()}, path, n_trials=10, n_cv=3)
    rows.unpersist()  # the predictions are written
    scores = EX.fold_scores(predictions)
    return EX.mean_over_fits(scores, ["name"]).withColumn("i", F.substring("name", 1, 2).cast("int"))


@query("train_test_scores")
def train_test_scores(spark, sf):
    return ML.train_test_scores(_bow_features(spark, sf), "lr", p=0.8, seed=0)


@query("dpgmm_clusters")
def dpgmm_clusters(spark, sf):
    """Dirichlet-process mixture (diagonal, alpha 5, at most 30 components)
    on the standardised word vectors; cluster sizes and first words."""
    w = _scaled_words(spark, sf)
    model = MX.DPGaussianMixture(n_components=30, alpha=5.0, max_iter=1000, tol=1e-4).fit(w)
    return model.predict(w).select("word", "cluster")


@query("doc_vectors")
def doc_vectors(spark, sf):
    """Per-message vectors (mean of word vectors) keyed by message id."""
    docs, model = _w2v(spark, sf)
    return ML.doc_mean_vectors(model, docs).select("doc_id", F.size("vector").cast("long").alias("dims"), "vector")


@query("dpgmm_doc_cluster_counts")
def dpgmm_doc_cluster_counts(spark, sf):
    """Word clusters end to end: eligible vocabulary (no_below 8, no_above
    0.9, at most 9000 words, with a vector, no stop words), standardised,
    Dirichlet-process mixture, then cluster counts per message."""
    from murmur.functions.wordlists import DEFAULT_STOPWORDS
    docs, model = _w2v(spark, sf)
    bow = V.bag_of_words(docs)
    kept = V.filter_extremes(V.vocabulary(bow), V.count_docs(docs), 8, 0.9, 9000)
    words = ML.cluster_vocabulary(kept, ML.word_vectors(model), DEFAULT_STOPWORDS).checkpoint()
    scaled = Standardizer.fit(words, "vector").transform(words, "vector")
    dp = MX.DPGaussianMixture(n_components=30, alpha=5.0, max_iter=1000, tol=1e-4).fit(scaled)
    assigned = dp.predict(scaled)
    return ML.doc_cluster_counts(V.tokens_long(docs), assigned)


@query("label_fraction_sweep")
def label_fraction_sweep(spark, sf):
    """Score log over shares of labelled rows, trials and classifiers: on each
    labelled subset repeated stratified cross-validation of the bag of words."""
    feats = _bow_features(spark, sf).persist()

    def run(g):
        part = EX.label_split(feats, "doc_id", g["p"], g["thresh"], g["n_trial"]).where("part = 'labelled'").drop("part")
        return EX.log_rows(EX.fold_scores(ML.cv_predictions(part, g["clf_base"], n_trials=1, n_cv=3)).withColumn("name", F.lit("BOW")), g, part.count())
    grid = [{"p": p, "thresh": 0.0, "n_trial": t, "clf_base": c} for p in (0.3, 0.6) for t in range(5) for c in ("lr", "sgd")]
    # a setting fits its three folds side by side
    at_once = max(1, EX.side_by_side(EX.feature_width(feats), 12) // 3)
    log = EX.sweep(spark, grid, run, scratch_path(spark, f"sweep-{uuid.uuid4().hex}"), at_once)
    feats.unpersist()
    return log


# ---- skip-gram over shuffled epochs ---------------------------------------------

@query("subsampled_tokens", f"""WITH toks AS ({TOKENS}),
t AS (SELECT doc_id, unnest(range(len(tokens)))::BIGINT AS pos, unnest(tokens) AS token FROM toks),
c AS (SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= 2),
u AS (SELECT token, n, 1e-3 * CAST((SELECT sum(n) FROM c) AS DOUBLE) AS usual FROM c)
SELECT doc_id, pos, token FROM t JOIN u USING (token)
WHERE CAST('0x' || substr(md5('1:0:' || doc_id || ':' || pos), 1, 8) AS UBIGINT)::DOUBLE / 4294967296::DOUBLE < (sqrt(n / usual) + 1) * usual / n""")
def subsampled_tokens(spark, sf):
    """Occurrences that the first epoch keeps (frequent words are thinned)."""
    return SG.subsampled(views.doc_tokens(spark, sf), 1e-3, 2, seed=1, epoch=0)


@query("w2v_shuffled")
def w2v_shuffled(spark, sf):
    """Word vectors trained over 20 shuffled epochs, frequent words thinned."""
    docs = views.doc_tokens(spark, sf)
    trainer = SG.SkipGram(size=100, window=10, min_count=2, epochs=20, step=0.05, least_step=1e-4, sample=1e-3, seed=1, partitions=8)
    model = stored(spark, "skipgram", vars(trainer) | {"mark": content_mark(docs, "doc_id", "tokens")},
                   lambda p: SG.SkipGramModel.load(spark, p), lambda: trainer.fit(docs), lambda m, p: m.save(spark, p))
    return model.table(spark).select("word", F.size("vector").cast("long").alias("dims"),
                                     F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


# ---- clusters of clusters, forms of covariance ------------------------------------

@query("covariance_forms")
def covariance_forms(spark, sf):
    """The words of large clusters, clustered anew with each form of covariance:
    cluster sizes and the mean log-likelihood of each form."""
    w = _scaled_words(spark, sf)
    first = MX.DPGaussianMixture(n_components=30, alpha=5.0, max_iter=200, tol=1e-4).fit(w).predict(w)
    some = MX.big_clusters(first, 25).select("word", "vector").persist()
    out = None
    for form in MX.FORMS:
        model = MX.DPGaussianMixture(n_components=20, alpha=30.0, max_iter=200, tol=1e-3, reg=1e-2, form=form).fit(some)
        sizes = model.predict(some).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
        sizes = sizes.select(F.lit(form).alias("form"), "cluster", "size", F.lit(model.log_likelihood).alias("log_likelihood"), F.lit(model.converged).alias("converged"))
        out = sizes if out is None else out.unionByName(sizes)
    return out


# a saved assignment: the label is the cluster; clusters above 45 members have three sub-clusters
_SAVED = """WITH e AS (SELECT 'w' || vec_id AS word, vec_id, label, count(*) OVER (PARTITION BY label) > 45 AS big FROM embeddings),
place AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT label FROM e WHERE big)),
c AS (SELECT vec_id // 10 AS doc_id, label::BIGINT AS col FROM e
      UNION ALL SELECT vec_id // 10, 10 + place * 5 + vec_id % 3 FROM e JOIN place USING (label) WHERE big)
"""


@query("two_level_counts", _SAVED + "SELECT doc_id, col AS \"column\", count(*) AS n FROM c GROUP BY ALL")
def two_level_counts(spark, sf):
    """Counts per message in the columns of clusters and sub-clusters, from a
    saved assignment of words."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("label").alias("cluster"))
    inside = MX.big_clusters(emb, 45).select("word", (F.col("vec_id") % 3).cast("int").alias("subcluster"))
    columns = MX.cluster_columns(emb.join(inside, "word", "left"), 10, 5)
    return MX.column_counts(emb.select(F.expr("vec_id div 10").alias("doc_id"), F.col("word").alias("token")), columns)


@query("two_level_clusters")
def two_level_clusters(spark, sf):
    """Words end to end: clusters, the large ones clustered again, and the
    columns that each word counts in."""
    model = MX.TwoLevelMixture(n_components=10, thresh=40, alpha=5.0, max_iter=200, tol=1e-4)
    return MX.cluster_columns(model.fit_predict(views.word_vectors(spark, sf)), model.k, model.sub)
