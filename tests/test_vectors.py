"""Message vector blocks and metrics on inline cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators.metrics import roc_auc
from murmur.operators.vectors import block_names, message_vector_blocks


def blocks_as_vector(spark, rows, d0, d1, size):
    df = spark.createDataFrame([(1, p, v) for p, v in enumerate(rows)], "doc_id long, pos long, vector array<double>")
    msgs = spark.createDataFrame([(1,)], "doc_id long")
    out = message_vector_blocks(df if rows else df.limit(0), msgs, d0=d0, d1=d1, size=size).collect()
    vals = sorted(((r["block"], r["dim"]), r["value"]) for r in out)
    return np.array([v for _, v in vals])


# worked by hand: x[k] - x[(k - i) mod size] over the dimensions, and
# x[t] - x[(t - i) mod n] over the words, then its steps
@pytest.mark.parametrize("rows,d0,d1,want", [
    ([[1.0, 2.0, 3.0]], 4, 3, {
        "00_avg": [1, 2, 3], "01_std": [0, 0, 0],
        "02_diff0_std_1": [0, 0, 0], "03_diff0_std_2": [0, 0, 0], "04_diff0_std_3": [0, 0, 0],
        "05_diff1_1": [-2, 1, 1], "06_diff1_std_1": [0, 0, 0], "07_diff1_2": [-1, -1, 2], "08_diff1_std_2": [0, 0, 0]}),
    ([[0.0, 0.0], [2.0, 4.0]], 2, 2, {
        "00_avg": [1, 2], "01_std": [1, 2], "02_diff0_std_1": [0, 0], "03_diff1_1": [-1, 1], "04_diff1_std_1": [1, 1]}),
    ([[0.0], [1.0], [5.0]], 3, 1, {
        "00_avg": [1], "01_std": [(14 / 3) ** 0.5], "02_diff0_std_1": [1.5], "03_diff0_std_2": [6]}),
    ([[4.0, 0.0], [0.0, 0.0], [2.0, 6.0], [2.0, 2.0]], 1, 2, {
        "00_avg": [2, 1], "01_std": [2 ** 0.5, 6 ** 0.5], "02_diff1_1": [0, 0], "03_diff1_std_1": [2 * 2 ** 0.5, 2 * 2 ** 0.5]}),
])
def test_message_vector_by_hand(spark, rows, d0, d1, want):
    got = blocks_as_vector(spark, rows, d0, d1, len(rows[0]))
    assert [n for n, *_ in block_names(d0, d1)] == list(want)
    assert np.allclose(got, np.concatenate(list(want.values())))


def test_message_vector_no_known_word(spark):
    got = blocks_as_vector(spark, [], 2, 2, 3)
    assert len(got) == 3 * (2 + 1 + 2) and not got.any()


def test_median_even_and_population_std(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 4.0, 8.0]], "x double")
    r = df.agg(F.median("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert r["m"] == 3.0 and math.isclose(r["s"], 2.680951, abs_tol=1e-6)


def test_roc_auc_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.1), (1, 0.4), (0, 0.4)]
    df = spark.createDataFrame(rows, "label long, score double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    exp = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(roc_auc(df).first()["roc_auc"], exp)
