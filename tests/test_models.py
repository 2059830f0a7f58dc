"""Model operators: invariants (no cross-library digits)."""

import math

import numpy as np

from murmur.operators.mixture import DPGaussianMixture, _digamma


def test_digamma_values():
    assert math.isclose(_digamma(np.array([1.0]))[0], -0.5772156649015329, rel_tol=1e-9)
    assert math.isclose(_digamma(np.array([0.5]))[0], -1.9635100260214235, rel_tol=1e-9)
    assert math.isclose(_digamma(np.array([10.0]))[0], 2.251752589066721, rel_tol=1e-9)


def test_dp_mixture_separates_clusters(spark):
    rnd = np.random.default_rng(0)
    a = rnd.normal(0.0, 0.1, size=(60, 3))
    b = rnd.normal(5.0, 0.1, size=(60, 3))
    rows = [(f"a{i}", v.tolist()) for i, v in enumerate(a)] + [(f"b{i}", v.tolist()) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "word string, vector array<double>")
    model = DPGaussianMixture(n_components=6, alpha=1.0, max_iter=100, tol=1e-6).fit(df)
    out = {r["word"]: r["cluster"] for r in model.predict(df).collect()}
    ca = {out[f"a{i}"] for i in range(60)}
    cb = {out[f"b{i}"] for i in range(60)}
    assert not (ca & cb)            # no component mixes the two groups
    assert len(ca | cb) <= 6
    assert math.isclose(model.weights.sum(), 1.0, rel_tol=1e-9)


def test_lda_distributions_and_determinism(spark):
    from pyspark.ml.linalg import Vectors
    from murmur.operators import models as ML
    rows = [(i, Vectors.dense([9.0, 8.0, 0.0, 1.0] if i % 2 else [0.0, 1.0, 9.0, 8.0])) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "features"]).coalesce(1)
    weights = []
    for _ in range(2):
        w = ML.doc_topic_weights(ML.fit_lda(df, k=2, max_iter=5, seed=3), df, min_prob=0.0).collect()
        weights.append({(r.doc_id, r.topic): round(r.weight, 9) for r in w})
    assert weights[0] == weights[1]
    for i in range(40):
        assert math.isclose(sum(v for (d, _), v in weights[0].items() if d == i), 1.0, rel_tol=1e-6)


def labelled(spark, n=120):
    from pyspark.ml.linalg import Vectors
    rnd = np.random.default_rng(1)
    rows = [(i, Vectors.dense((rnd.normal(size=3) + (1.5 if i % 3 == 0 else 0)).tolist()), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, ["doc_id", "features", "label"]).coalesce(2)


def test_cross_validation_beats_the_majority(spark):
    from murmur.operators import models as ML
    scores = ML.cv_scores(labelled(spark), "lr", n_trials=2, n_cv=3)
    assert scores.count() == 6
    mean = ML.mean_scores(scores).first()
    assert mean.accuracy > 2 / 3 and mean.n_trials == 2 and mean.n_fits == 6 and 0.5 < mean.roc_auc <= 1
    svc = ML.cv_scores(labelled(spark), "svc", n_trials=1, n_cv=3, direct=True)
    assert svc.count() == 3 and svc.where("iterations > 0 AND converged IS NOT NULL AND accuracy > 0.6").count() == 3
    grid = ML.grid_search(labelled(spark), reg_params=(0.01, 100.0)).collect()
    assert [r.best for r in sorted(grid, key=lambda r: -r.accuracy)] == [True, False]


def test_auc_is_exact(spark):
    from murmur.operators import metrics as M
    from murmur.operators import models as ML
    from pyspark.ml.linalg import Vectors
    rnd = np.random.default_rng(2)
    score, label = rnd.normal(size=3000), rnd.integers(0, 2, 3000)
    df = spark.createDataFrame([(float(l), 1.0 if s > 0 else 0.0, Vectors.dense([-s, s]), float(s)) for s, l in zip(score.tolist(), label.tolist())],
                               ["label", "prediction", "rawPrediction", "score"])
    assert math.isclose(ML._fold_scores(df, "label")["roc_auc"], M.roc_auc(df).first().roc_auc, rel_tol=1e-9)


def test_word_vectors_have_unit_length(spark):
    from murmur.operators import models as ML
    docs = spark.createDataFrame([(i, ["a", "b", "c", "d"]) for i in range(30)], "doc_id long, tokens array<string>")
    vectors = ML.word_vectors(ML.train_word2vec(docs, size=4, max_iter=2, min_count=1)).collect()
    assert len(vectors) == 4 and all(math.isclose(math.sqrt(sum(x * x for x in r.vector)), 1.0, rel_tol=1e-5) for r in vectors)


def test_word_vectors_see_rows_whatever_their_ids(spark):
    from murmur.operators import models as ML
    rows = [(None if i % 3 else 7, ["a", "b", "c", "d"]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    one, two = (ML.train_word2vec(docs, size=4, max_iter=2, min_count=1, partitions=2) for _ in range(2))
    assert sorted(one.words) == ["a", "b", "c", "d"] and np.array_equal(one.vectors, two.vectors)


def test_message_means_by_hand(spark):
    from murmur.operators import models as ML
    from murmur.operators.skipgram import SkipGramModel
    model = SkipGramModel(["a", "b"], np.array([[1, 2], [3, 5]], np.float32))
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["b", "zz"]), (None, ["zz"]), (2, [])], "doc_id long, tokens array<string>")
    got = sorted((r.doc_id or 0, list(r.vector)) for r in ML.doc_mean_vectors(model, docs).collect())
    assert got == [(0, [0.0, 0.0]), (1, [1.5, 2.5]), (1, [5 / 3, 3.0]), (2, [0.0, 0.0])]


def test_tfidf_vectors_by_hand(spark):
    from murmur.operators import models as ML
    from murmur.operators import vocab as V
    texts = [["b", "a", "b"], ["a", "c"], [], ["c", "b", "zz"], ["zz", "a"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    bow = V.bag_of_words(docs)
    kept = V.filter_extremes(V.vocabulary(bow), 5, 2, 0.9).checkpoint()
    ids = {r.token: r.token_id for r in kept.collect()}
    idf = {w: math.log2(5 / sum(w in t for t in texts)) for w in ids}
    got = {r.doc_id: r.features for r in ML.tfidf_vectors(docs, bow, kept, 5).collect()}
    plain = {r.doc_id: r.features for r in ML.count_vectors(docs, bow, kept).collect()}
    assert set(got) == set(plain) == set(range(5)) and sorted(ids.values()) == list(range(4))
    for i, t in enumerate(texts):
        want = np.zeros(4)
        for w in t:
            want[ids[w]] += 1
        assert plain[i].toArray().tolist() == want.tolist()
        want *= [idf[w] for w in sorted(ids, key=ids.get)]
        assert np.allclose(got[i].toArray(), want / (np.linalg.norm(want) or 1), rtol=1e-12)


def test_features_number_the_words_of_labelled_rows_and_weigh_by_all(spark, tmp_path):
    from murmur.plans import q_models
    from murmur.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    texts = ["apple banana banana", "banana cherry", "cherry damson", "damson elder", "elder fig", "fig apple"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long") \
        .coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in q_models._bow_features(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1] and [got[k].label for k in (0, 1)] == [1, 0]
    # apple, banana, cherry; each stands in two of six messages
    assert got[0].features.size == 3
    assert np.allclose(got[0].features.toArray(), np.array([1, 2, 0]) / math.sqrt(5)) and np.allclose(got[1].features.toArray(), np.array([0, 1, 1]) / math.sqrt(2))


def test_model_vocabularies_have_no_cap(spark, tmp_path):
    from murmur.plans import q_models
    from murmur.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    letters = "abcdefghijklmnopqrst"
    word = lambda i: "w" + "".join(letters[i // 20 ** k % 20] for k in range(4))
    n = 100_500
    rows = [(r * 30 + k, " ".join(word(i) for i in range(k, n, 30)), "en", "s", 1) for r in range(10) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for feats in (q_models._bow_features(spark, str(tmp_path)), q_models._lda_inputs(spark, str(tmp_path))[0]):
        got = [(r.features.size, r.features.numNonzeros()) for r in feats.collect()]
        assert len(got) == 300 and {g[0] for g in got} == {n} and sum(g[1] for g in got) == 10 * n


def test_embedding_experiment_scores_every_nested_set(spark, tmp_path, monkeypatch):
    from murmur.operators.vectors import block_names
    from murmur.plans import q_models
    names = [n for n, *_ in block_names(1, 5)]
    rnd = np.random.default_rng(7)
    # the class shows in the fourth block alone
    cells = [(i, n, d, float(rnd.normal() + (3 * (i % 2) if b == 3 and d < 40 else 0))) for i in range(48) for b, n in enumerate(names) for d in range(100)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(48)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    blocks = spark.createDataFrame(cells, "doc_id long, block string, dim long, value double")
    monkeypatch.setattr(q_models, "_message_blocks", lambda *_: blocks)
    got = sorted((r.i, r.name, r.n_trials, r.n_fits, r.accuracy) for r in q_models.embedding_experiment(spark, str(tmp_path)).collect())
    assert [g[:4] for g in got] == [(i, n, 10, 30) for i, n in enumerate(names)]
    assert max(g[4] for g in got[:3]) < 0.75 < min(g[4] for g in got[3:5])


def test_fits_in_lockstep_are_those_one_by_one(spark):
    import tempfile
    from pyspark.ml.functions import array_to_vector
    from murmur.operators import lockstep as LS
    from murmur.operators import models as ML
    from murmur.operators.vectors import feature_slice
    rnd = np.random.default_rng(5)
    data = spark.createDataFrame([(k, int(k % 3 == 0), [float(v) for v in rnd.normal(size=4) + (k % 3 == 0)]) for k in range(90)],
                                 "doc_id long, label int, x array<double>").repartition(3)
    path = tempfile.mkdtemp(prefix="murmur-test-") + "/run"
    got = LS.predict_folds_together(data, {"two": 2, "four": 4}, path, 2, 3, tol=1e-9)
    one = ML.cv_predictions(data, "lr", 2, 3, sets={"two": array_to_vector(feature_slice("x", 0, 2)), "four": array_to_vector(feature_slice("x", 0, 4))})
    key = lambda r: (r.name, r.n_trial, r.doc_id)
    a, b = (sorted(df.collect(), key=key) for df in (got, one))
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) == 2 * 2 * 90
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=2e-3)
    assert all(r.converged for r in a) and [r.fold for r in a] == [r.fold for r in b]
    again = LS.predict_folds_together(data, {"two": 2, "four": 4}, path, 3, 3)
    assert again.count() == 3 * 2 * 90 and got.exceptAll(again.where("n_trial < 2")).count() == 0


def test_quasi_newton_finds_the_least_point():
    from murmur.operators.lockstep import quasi_newton
    r = np.random.default_rng(2)
    a = r.normal(size=(6, 6))
    a, b = a @ a.T + np.eye(6), r.normal(size=6)
    w = quasi_newton(np.zeros(6), 100, 1e-12)
    x = next(w)
    try:
        while True:
            x = w.send((0.5 * x @ a @ x - b @ x, a @ x - b))
    except StopIteration as end:
        x, _, settled = end.value
    assert settled and np.allclose(a @ x, b, atol=1e-5)


def test_models_travel_after_phrases_were_learned(spark):
    """A fit's summary holds its session, which must stay one that can be sent."""
    from murmur.operators import models as ML
    from murmur.operators.phrases import phrase_scores
    phrase_scores(spark.createDataFrame([(1, ["new", "york"] * 3)], "doc_id long, tokens array<string>"), 1, 0.0).collect()
    out = ML.out_of_fold(labelled(spark), "lr", n_cv=2)
    assert out.count() == 120


def test_message_vectors_are_what_the_query_returns(spark, monkeypatch):
    """doc_vectors gives the vectors themselves, not only how long they are."""
    from murmur.operators.skipgram import SkipGramModel
    from murmur.plans import q_models
    model = SkipGramModel(["a", "b"], np.array([[1, 2], [3, 5]], np.float32))
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["zz"])], "doc_id long, tokens array<string>")
    monkeypatch.setattr(q_models, "_w2v", lambda *_: (docs, model))
    got = {r.doc_id: (r.dims, list(r.vector)) for r in q_models.doc_vectors(spark, "").collect()}
    assert got == {1: (2, [5 / 3, 3.0]), 2: (2, [3.0, 5.0]), 3: (2, [0.0, 0.0])}
