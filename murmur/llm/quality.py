"""Quality scores learned from preference pairs (Bradley-Terry).

A document is described by how its characters follow one another (shares of
pairs of character classes), and by how much its words and lines repeat.  The
model holds that document ``a`` is preferred to document ``b`` with probability
``sigmoid(w . (x_a - x_b))``; ``w`` minimises the logistic loss over all pairs of
a good and a bad document of the training sample.  Only the differences of scores
mean anything then, so the place of the decision is a quantile of the scores of
all labelled documents: the one at which the shares of good documents lost and of
bad ones kept are least together.

Scores are 0 to 1 and lie at ``CUT`` where the quantile lies.  Null and empty
texts have the features of an empty text and a score like all others.  Ids may
repeat (a labelled id counts once for each of its rows), labels may be null (not
used), further columns are ignored.  Without a good or without a bad labelled
document all scores are the same: 1 if there are good ones only, else 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import map_slices, on_workers, texts, with_id, words, written

#: Score at which a document counts as good.
CUT = 0.3
#: Bound of the training sample, good documents and bad ones; steps of the fit.
SAMPLE, STEPS, RIDGE = 1200, 300, 1e-3
#: Standard deviations from the mean that a feature counts at most.
FAR = 2.0
#: Quantiles among which the place of the decision is chosen.
QUANTILES = 1000

#: Bytes whose pairs are counted at a time.
AT_ONCE = 1 << 21

#: Character classes, each a string of ASCII characters; what follows are the
#: classes of all other ASCII characters, and of the bytes of other characters.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:", "!?", "'\"()[]-", "/@_=<>", "#$%&*+~^|\\"]
KINDS = len(CLASSES) + 3
SHAPES = ["log_words", "word_chars", "distinct", "again", "top_word", "one_char", "line_again", "line_words"]
WIDTH = KINDS * KINDS + len(SHAPES)


def class_table() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES):
        out[[ord(c) for c in members]] = k
    out[128:192], out[192:] = len(CLASSES) + 1, len(CLASSES) + 2
    return out


TABLE = class_table()


def runs_per(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the items of each document: how many, how many distinct ones, how many
    equal the one before, and how often the most frequent one stands."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(n), np.int64)
    if len(codes) > 1:
        same = np.bincount(doc[1:][(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n))
    key, count = np.unique(doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes, return_counts=True)
    of = key // (int(codes.max(initial=0)) + 1)
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, of, count)
    return n, np.bincount(of, minlength=len(n)), same, top


def features(text: pa.Array) -> np.ndarray:
    """A row a text: square roots of shares of class pairs, then ``SHAPES``."""
    rows = len(text)
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(pc.binary_join(pa.array([text.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b"")[0].as_py(), np.uint8)
    off = np.cumsum(size)
    pairs = np.zeros(rows * KINDS * KINDS, np.int64)
    for lo in range(0, len(raw) - 1, AT_ONCE):  # a text may be long
        kind = TABLE[raw[lo:lo + AT_ONCE + 1]].astype(np.int64)
        doc = np.searchsorted(off, np.arange(lo, lo + len(kind)), "right")
        code = doc[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        pairs += np.bincount(code[doc[1:] == doc[:-1]], minlength=len(pairs))
    pairs = pairs.reshape(rows, -1).astype(float)
    pairs = np.sqrt(pairs / np.maximum(1, size - 1)[:, None])
    codes, distinct, off = words(text)
    n, kinds, same, top = runs_per(codes, off)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False) if len(distinct) else np.empty(0, np.int64)
    short = np.bincount(np.repeat(np.arange(rows), n)[length[codes] == 1], minlength=rows) if len(codes) else np.zeros(rows)
    lines = pc.split_pattern(text, "\n")
    at = lines.offsets.to_numpy().astype(np.int64)
    coded = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    m, line_kinds, _, _ = runs_per(coded, at - at[0])
    w = np.maximum(n, 1)
    more = [np.log1p(n), np.log1p(size / w), kinds / w, same / w, top / w, short / w, 1 - line_kinds / np.maximum(m, 1), np.log1p(n / np.maximum(m, 1))]
    return np.hstack([pairs, np.array(more, float).T])


def standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features; what lies far out (very short texts) counts as ``FAR``."""
    return np.clip((x - centre) / scale, -FAR, FAR)


class Ranking:
    """Weights of the preference model, and the quantile that decides."""

    def __init__(self, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, threshold: float, slope: float):
        self.weights, self.centre, self.scale, self.threshold, self.slope = weights, centre, scale, threshold, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        # row by row, so that a text scores alike whatever batch it is in
        return (standard(x, self.centre, self.scale) * self.weights).sum(axis=1)

    def score(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (raw - self.threshold), -30, 30) + math.log(CUT / (1 - CUT))
        return np.where(raw >= self.threshold, np.maximum(1 / (1 + np.exp(-z)), CUT), np.minimum(1 / (1 + np.exp(-z)), np.nextafter(CUT, 0)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """``w`` of least mean logistic loss over all pairs (good, bad), by descent
    with momentum.  The gradient over the pairs needs the probabilities of all
    pairs, but only row and column sums of them."""
    w, move = np.zeros(good.shape[1]), np.zeros(good.shape[1])
    best, least, rate = w, np.inf, 0.5
    for _ in range(steps):
        gap = (good @ w)[:, None] - (bad @ w)[None, :]
        loss = np.logaddexp(0, -gap).mean() + ridge / 2 * w @ w
        if loss > least * 1.05:  # a step too far: back, and slower
            w, move, rate = best.copy(), np.zeros_like(w), rate / 2
            continue
        if loss < least:
            best, least = w.copy(), loss
        wrong = 1 / (1 + np.exp(np.clip(gap, -30, 30)))
        slope = -(wrong.sum(1) @ good - wrong.sum(0) @ bad) / wrong.size + ridge * w
        move = 0.9 * move - rate * slope
        w = w + move
    return best


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """``(doc_id, _label)``, an id once (the higher of two labels)."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))


def sampled_features(docs: DataFrame, known: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample: the distinct texts of ``limit``
    labelled ids of each label, those whose hash is least (``limit`` texts at
    most, if ids repeat).  Only ids and features travel."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(41))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    pick = [there.where(F.col("_label") == k).orderBy(order, "doc_id").limit(limit) for k in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * limit ids at most
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.select("_label", F.xxhash64("text").alias("h"), "text")

    def start():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(texts(batch))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([batch.column("_label"), batch.column("h"), flat], ["_label", "h", "x"])
        return part

    each = (map_slices(rows, "text", "_label int, h long, x array<double>", start)
            .groupBy("_label", "h").agg(F.first("x").alias("x")))
    got = each.where("_label = 0").orderBy("h").limit(limit).unionByName(each.where("_label = 1").orderBy("h").limit(limit)).collect()
    got = sorted(got, key=lambda r: (r["_label"], r.h))
    return np.array([r.x for r in got]).reshape(-1, WIDTH), np.array([r["_label"] for r in got], int)


def ranked(docs: DataFrame, model: Ranking) -> DataFrame:
    """``(doc_id, raw double)`` of every document."""
    schema = with_id(docs, "raw double")
    spark = on_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def start():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.raw(features(texts(batch))))], ["doc_id", "raw"])
        return part

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", schema, start)


def threshold(raw: DataFrame, quantiles: int = QUANTILES) -> tuple[float, float]:
    """The quantile of all scores in ``raw`` (``raw``, ``_label``) that parts the
    labels best, and how far the good scores lie above the bad ones."""
    steps = [i / quantiles for i in range(quantiles + 1)]
    mixed = raw.agg(F.percentile_approx("raw", F.array(*map(F.lit, steps)), F.lit(10 * quantiles)).alias("q")).first().q
    cut = sorted(set(mixed))
    # how many of each label lie at or above each of the bounded list of cuts
    at = F.size(F.filter(F.array(*map(F.lit, cut)), lambda c: c <= F.col("raw"))).alias("at")
    counts = np.zeros((2, len(cut) + 1))
    for r in raw.groupBy("_label", at).agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("m")).collect():
        counts[r["_label"], r["at"]] = r["n"]
    share = counts / np.maximum(1, counts.sum(1, keepdims=True))
    # a cut at place k keeps what lies at it or above, that is at > k
    lost = np.cumsum(share[1])[:-1]
    held = 1 - np.cumsum(share[0])[:-1]
    cost = lost + held
    good = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = int(good[len(good) // 2])
    means = {r["_label"]: r["m"] for r in raw.groupBy("_label").agg(F.avg("raw").alias("m")).collect()}
    below = cut[k - 1] if k else cut[k]
    return (below + cut[k]) / 2, max(means[1] - means[0], 1e-6)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Ranking:
    """Learn from the labelled rows of ``docs``: weights from a bounded sample,
    the threshold from the scores of all of them."""
    on_workers(docs.sparkSession)
    known = known_labels(labels, column)
    x, y = sampled_features(docs, known, SAMPLE)
    if not (y == 0).any() or not (y == 1).any():
        return Ranking(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), -1.0 if (y == 1).any() else 1.0, 60.0)
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    z = standard(x, centre, scale)
    model = Ranking(fit_pairs(z[y == 1], z[y == 0]), centre, scale, 0.0, 1.0)
    scores = written(ranked(docs, model).join(known, "doc_id").select("raw", "_label"), "scores")  # texts stay where they are
    model.threshold, gap = threshold(scores)
    model.slope = 8.0 / gap
    return model


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """``(doc_id, score double, predicted int)`` of every document."""
    schema = with_id(docs, "score double, predicted int")
    spark = on_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def start():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = shared.value.score(shared.value.raw(features(texts(batch))))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], schema.fieldNames())
        return part

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", schema, start)
