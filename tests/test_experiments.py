"""Experiments from saved predictions, mixtures of all forms, two levels,
backfill, harvested fields, per-row series."""

import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from murmur.functions.plotdata import row_series
from murmur.operators import experiments as EX
from murmur.operators import mixture as MX
from murmur.operators.metrics import roc_auc
from murmur.operators.sampling import stratified_folds
from murmur.operators.vectors import block_coordinates, feature_slice
from murmur.sources import io as IO
from murmur.streaming.backfill import Backfill


def tmp():
    return tempfile.mkdtemp(prefix="murmur-test-")


def rows(spark, n=90):
    return spark.createDataFrame([(k, int(k % 3 == 0), float(k % 3 * 10 + k % 7), f"t{k}") for k in range(n)], "doc_id long, label int, x double, text string")


# ---- folds, predictions, scores -------------------------------------------------

def test_trial_folds_are_those_of_each_trial(spark):
    df = rows(spark)
    got = {r.doc_id: list(r.folds) for r in EX.trial_folds(df, "label", "doc_id", 3, 4).collect()}
    for t in range(4):
        one = {r.doc_id: r.fold for r in stratified_folds(df.select("doc_id", "label"), "label", "doc_id", 3, t).collect()}
        assert {k: v[t] for k, v in got.items()} == one


def test_label_split_is_nested_and_exact(spark):
    ids = spark.range(97).withColumnRenamed("id", "doc_id")
    parts = {}
    for p in (0.1, 0.25, 0.7):
        got = {r.doc_id: r.part for r in EX.label_split(ids, "doc_id", p, 0.5, trial=3).collect()}
        parts[p] = {k for k, v in got.items() if v == "labelled"}
        rest = 97 - len(parts[p])
        assert len(got) == 97 and len(parts[p]) == math.ceil(97 * p)
        assert sum(v == "unlabelled" for v in got.values()) == math.ceil(rest * 0.5)
    assert parts[0.1] < parts[0.25] < parts[0.7]
    assert {r.part for r in EX.label_split(ids, "doc_id", 1, 0.5).collect()} == {"labelled"}
    assert {r.part for r in EX.label_split(ids, "doc_id", 0.5, 1).collect()} == {"labelled", "unlabelled"}
    assert {r.part for r in EX.label_split(ids, "doc_id", 0.5, 0).collect()} == {"labelled", "unused"}


def test_grouped_area_is_that_of_each_group(spark):
    r = random.Random(3)
    data = [(g, r.randrange(2), float(r.randrange(6))) for g in range(4) for _ in range(40)] + [(9, 1, 0.5)]
    df = spark.createDataFrame(data, "g long, label int, score double")
    got = {x.g: x.roc_auc for x in EX.grouped_auc(df, ["g"]).collect()}
    assert got[9] is None
    for g in range(4):
        assert got[g] == pytest.approx(roc_auc(df.where(F.col("g") == g)).first().roc_auc)


def test_fits_that_are_saved_are_not_made_again(spark):
    path, made = f"{tmp()}/run", []

    def classifier(n):
        made.append(n)
        return EX.NearestMean("x")
    first = EX.predict_folds(rows(spark), classifier, path, 2, 3)
    assert len(made) == 6 and first.count() == 180
    more = EX.predict_folds(rows(spark), classifier, path, 3, 3)
    assert len(made) == 9 and more.count() == 270
    # a fit that was cut short: rows there, the writer's mark is not
    os.remove(f"{path}/rows/name=all/n_trial=1/fold=2/_SUCCESS")
    again = EX.predict_folds(rows(spark), classifier, path, 3, 3)
    assert len(made) == 10 and again.count() == 270
    assert EX.fold_scores(again).count() == 9


def test_direct_area_is_that_of_the_hard_predictions(spark):
    p = EX.predict_folds(rows(spark), lambda n: EX.NearestMean("x"), f"{tmp()}/run", 1, 3)
    for s in EX.fold_scores(p, direct=True).collect():
        mine = [(r.label, r.prediction) for r in p.where(F.col("fold") == s.fold).collect()]
        tpr = np.mean([y for x, y in mine if x == 1])
        tnr = np.mean([1 - y for x, y in mine if x == 0])
        assert s.roc_auc == pytest.approx((tpr + tnr) / 2)


def test_feature_sets_share_their_folds(spark):
    from murmur.operators.models import cv_predictions
    r = np.random.default_rng(1)
    data = spark.createDataFrame([(k, int(k % 2), [float(v) for v in r.normal(size=4) + (k % 2) * np.array([0, 0, 0, 3.0])]) for k in range(60)],
                                 "doc_id long, label int, x array<double>")
    sets = {"few": array_to_vector(feature_slice("x", 0, 2)), "all": array_to_vector(feature_slice("x", 0, 4))}
    p = cv_predictions(data, n_trials=1, n_cv=3, sets=sets)
    folds = p.groupBy("doc_id").agg(F.countDistinct("fold").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {(f.n, f["rows"]) for f in folds} == {(1, 2)}
    means = {m.name: m.accuracy for m in EX.mean_over_fits(EX.fold_scores(p), ["name"]).collect()}
    assert means["all"] > 0.85 > means["few"]
    assert {x.converged for x in p.select("converged").distinct().collect()} <= {True, False}


def test_exploration_reads_the_saved_predictions(spark):
    data = rows(spark)
    p = EX.predict_folds(data, lambda n: EX.NearestMean("x"), f"{tmp()}/run", 1, 5)
    parts = EX.explored(p, data)
    wrong = {(r.doc_id, r.label) for r in p.where("label <> prediction").collect()}
    assert {r.doc_id for r in parts["false_positives"].collect()} == {k for k, y in wrong if y == 0}
    assert {r.doc_id for r in parts["false_negatives"].collect()} == {k for k, y in wrong if y == 1}
    assert sum(r.n for r in parts["matrix"].collect()) == 90
    base = tmp()
    EX.save_explored(parts, base)
    back = IO.read_messages(spark, f"{base}/positives", ["id_str", "text"])
    assert {r.text for r in back.collect()} == {f"t{k}" for k in range(0, 90, 3)}


def test_sweep_goes_on_from_its_log(spark):
    path, ran = f"{tmp()}/log", []

    def run(g):
        ran.append(g["n_trial"])
        if len(ran) == 3:
            raise RuntimeError("cut short")
        p = EX.predict_folds(rows(spark), lambda n: EX.NearestMean("x"), f"{tmp()}/run", 1, 3)
        return EX.log_rows(EX.fold_scores(p), g, 90)
    grid = [{"p": 0.5, "thresh": 0.25, "n_trial": t, "clf_base": "mean"} for t in range(4)]
    with pytest.raises(RuntimeError):
        EX.sweep(spark, grid, run, path, at_once=1)
    log = EX.sweep(spark, grid, run, path, at_once=1)
    assert sorted(ran) == [0, 1, 2, 2, 3] or len(ran) == 5
    got = log.collect()
    assert len(got) == 12 and {(r.n_trial, r.i) for r in got} == {(t, i) for t in range(4) for i in range(3)}
    assert {r.corpus_size for r in got} == {90 * (0.5 + 0.25 - 0.125)}


def test_blocks_have_coordinates():
    at = block_coordinates(10, 1, 2)
    assert at == {"00_avg": (0, 10), "01_std": (10, 20), "02_diff1_1": (20, 30), "03_diff1_std_1": (30, 40)}


# ---- mixtures --------------------------------------------------------------------------

def vectors(spark, x):
    return spark.createDataFrame([(f"w{k}", [float(a) for a in v]) for k, v in enumerate(x)], "word string, vector array<double>").repartition(4)


def ellipses(n=400, seed=5):
    """Two long, tilted groups that cross no more than their ends: only a matrix
    a component describes them."""
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, 2)) * [3.0, 0.15]
    turn = lambda t: np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    return np.vstack([a @ turn(0.8).T + [0, 3], a @ turn(-0.8).T + [0, -3]])


def test_forms_of_covariance(spark):
    x = ellipses()
    df, truth = vectors(spark, x), np.repeat([0, 1], 400)
    likelihood = {}
    for form in MX.FORMS:
        model = MX.DPGaussianMixture(n_components=2, alpha=1.0, max_iter=100, tol=1e-6, form=form, seed=2).fit(df)
        likelihood[form] = model.log_likelihood
        assert model.mixture.cov.shape == {"diag": (2, 2), "spherical": (2,), "tied": (2, 2), "full": (2, 2, 2)}[form]
        if form == "full":
            got = {int(r.word[1:]): r.cluster for r in model.predict(df).collect()}
            same = np.mean([got[k] == truth[k] for k in range(len(x))])
            assert max(same, 1 - same) > 0.97
            values = np.sort(np.linalg.eigvalsh(model.mixture.cov), axis=1)
            assert np.allclose(values, [[0.0225, 9], [0.0225, 9]], rtol=0.25)
    assert likelihood["full"] > likelihood["tied"] + 0.5 and likelihood["full"] > likelihood["diag"] + 0.5
    assert likelihood["diag"] >= likelihood["spherical"] - 1e-6


@pytest.mark.parametrize("form", MX.FORMS)
def test_update_is_the_weighted_moments(form):
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 3))
    m = MX.first_mixture(form, x[:4], 2.0)
    w = np.exp(m.log_resp(x)[0])
    assert np.allclose(w.sum(axis=1), 1)
    new, _, n = m.updated(m.statistics(x[:20]) + m.statistics(x[20:]), 2.0, 0.0)
    assert np.allclose(n, w.sum(axis=0)) and np.allclose(new.means, (w.T @ x) / n[:, None])
    full = np.array([((x - new.means[c]) * w[:, c:c + 1]).T @ (x - new.means[c]) / n[c] for c in range(4)])
    want = {"full": full, "diag": np.diagonal(full, axis1=1, axis2=2), "spherical": np.trace(full, axis1=1, axis2=2) / 3,
            "tied": (full * n[:, None, None]).sum(axis=0) / 50}[form]
    assert np.allclose(new.cov, want)


def test_groups_fit_as_if_alone(spark):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(size=(60, 2)), r.normal(size=(60, 2)) + [6, 0]])
    both = [(g, f"w{g}{k}", [float(a) for a in v + g]) for g in (2, 7) for k, v in enumerate(x)]
    df = spark.createDataFrame(both, "g int, word string, vector array<double>").repartition(3)
    model = MX.DPGaussianMixture(n_components=3, alpha=1.0, max_iter=60, tol=1e-6)
    fitted = model.fit_groups(df, "g")
    assert set(fitted) == {2, 7}
    alone = MX.DPGaussianMixture(n_components=3, alpha=1.0, max_iter=60, tol=1e-6).fit_groups(df.where("g = 7"), "g")
    assert np.allclose(fitted[7].mixture.means, alone[7].mixture.means) and fitted[7].n_iter == alone[7].n_iter


def test_mixture_is_saved_and_loaded(spark):
    df = vectors(spark, ellipses(50))
    model = MX.DPGaussianMixture(n_components=3, form="full", max_iter=5).fit(df)
    path = f"{tmp()}/m"
    model.save(spark, path)
    back = MX.DPGaussianMixture(n_components=3, form="full").load(spark, path)
    one, two = ({r.word: r.cluster for r in m.predict(df).collect()} for m in (model, back))
    assert one == two and back.n_iter == model.n_iter
    with pytest.raises(ValueError):
        MX.DPGaussianMixture(form="round")


def test_large_clusters_are_clustered_again(spark):
    r = np.random.default_rng(6)
    centres = [[0, 0], [0.8, 0], [30, 30]]  # two near groups that the first level may take for one
    x = np.vstack([r.normal(size=(80, 2)) * 0.1 + c for c in centres[:2]] + [r.normal(size=(20, 2)) * 0.1 + centres[2]])
    model = MX.TwoLevelMixture(n_components=4, thresh=60, alpha=1.0, max_iter=60)
    words = {r.word: (r.cluster, r.subcluster) for r in model.fit_predict(vectors(spark, x)).collect()}
    assert len(words) == 180
    sizes = {c: sum(v[0] == c for v in words.values()) for c, _ in words.values()}
    assert all((s is not None) == (sizes[c] > 60) for c, s in words.values())
    assert {c for c, n in sizes.items() if n > 60} == set(model.subs)
    none = MX.TwoLevelMixture(n_components=3, thresh=0, max_iter=10).fit_predict(vectors(spark, x))
    assert none.where("subcluster IS NOT NULL").count() == 0


def test_columns_follow_the_blocks(spark):
    words = spark.createDataFrame([("a", 0, None), ("b", 2, 1), ("c", 2, 0), ("d", 5, 3)], "word string, cluster int, subcluster int")
    got = {(r.word, r.column) for r in MX.cluster_columns(words, 6, 4).collect()}
    assert got == {("a", 0), ("b", 2), ("b", 7), ("c", 2), ("c", 6), ("d", 5), ("d", 13)}


# ---- harvest --------------------------------------------------------------------------

def test_backfill_outlives_a_kill_at_any_place(spark):
    source = spark.range(1, 101).withColumn("text", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))

    def job(path):
        return Backfill(source, path, "id", 10, 90, F.col("text") == "x", page_size=4, max_pages=2)
    whole = job(tmp()).run().rows().collect()
    assert sorted(r.id for r in whole) == list(range(12, 91, 2)) and {r.batch for r in whole} == set(range(5))
    for at in range(6):
        path = tmp()
        j = job(path).run(at)

        def dies(*_):
            raise InterruptedError
        j.publish = dies
        try:
            j.step()
        except InterruptedError:
            pass
        assert job(path).run().rows().orderBy("id").collect() == sorted(whole, key=lambda r: r.id)
    with pytest.raises(ValueError):
        Backfill(source, tmp(), "id", 5, 5).step()
    assert Backfill(source.limit(0), tmp(), "id").run().rows().count() == 0


def test_harvested_fields(spark):
    assert len(IO.HARVEST_FIELDS) == 42
    path = f"{tmp()}/h.json"
    with open(path, "w") as f:
        f.write('{"text":"a","user":{"name":"n","id_str":7},"coordinates":{"coordinates":[1.5,2]},"entities":{"urls":[{"url":"u"}]},"other":1}\n')
        f.write('{"text":null,"place":{"bounding_box":{"coordinates":[[[3,4],[5,6]]]}}}\nno json\n\n')
    got = IO.read_harvest(spark, path).collect()
    assert list(got[0].asDict()) == list(IO.HARVEST_FIELDS)
    a = next(r for r in got if r.text == "a")
    assert (a.name, a.user_id_str, a.lon, a.lat, a.url, a.expanded_url, a.place_lat) == ("n", "7", "1.5", "2", "u", "NA", "NA")
    b = next(r for r in got if r.place_lat != "NA")
    assert (b.text, b.place_lat, b.place_lon) == ("NA", "4", "3")
    assert sum(set(r.asDict().values()) == {"NA"} for r in got) == 2


def test_series_are_numbered_each_from_zero(spark):
    data = [("a", 3, 1.0), ("a", 1, 2.0), (None, 2, 3.0), (None, 1, 4.0), ("b", 1, 5.0)]
    got = row_series(spark.createDataFrame(data, "s string, o int, y double"), "s", ["o"], "y").collect()
    assert {(r.s, r.x, r.y) for r in got} == {("a", 0, 2.0), ("a", 1, 1.0), (None, 0, 4.0), (None, 1, 3.0), ("b", 0, 5.0)}
