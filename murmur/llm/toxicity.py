"""Toxicity with a subsequence string kernel and Nyström landmarks.

The strings are words with all but their letters taken out, in lower case with
a start mark (``i.d-i0ot`` becomes ``^idiot``), and runs of single letters
joined (``i d i o t``).  The kernel compares all subsequences of three
characters that span at most ``SPAN`` of them, each weighted by ``DECAY`` for
every character skipped, and is normalised; so an insult with characters put
in or left out stays near the insult.

A support vector machine is trained on kernel values to a set of landmarks
(Nyström map).  Labels belong to documents: a toxic document is a bag of
sentences at least one of which is toxic, so training picks the string that
speaks most for it in each toxic bag, fits those picks, and copies of them with a letter
put in, against the strings of clean sentences, and repeats.  As the decision is linear in the kernel and the kernel
in subsequence counts, the fitted machine folds into one weight a subsequence.
A document's score is that of its most toxic string, through a sigmoid around
the decision value that parts the training bags best.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import map_slices, on_workers, texts, with_id, words
from murmur.llm.wordtable import Remembered, in_worker

SPAN, DECAY = 5, 0.6
#: Bounds of the training sample: toxic and clean documents, strings of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_STRINGS = 1000, 1500, 800
LANDMARKS, ROUNDS = 200, 6
#: Standard errors by which a string's share of toxic bags must lie above its
#: share of clean ones to count as toxic wherever it stands.
SURE = 6.0
#: Steepness of the sigmoid that turns decisions into scores.
SLOPE = 3.0
#: Weight of the copies with a letter put in, against that of the picks.
GAPPED = 0.1
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def cleaned(word: str) -> str:
    return _NOT_LETTERS.sub("", word.lower())


def symbols(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers below 64 (0: start mark) and the string of each."""
    joined = "".join("^" + s for s in strings)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sym = np.where((code >= 97) & (code <= 122), code - 96, 27 + code % 37)
    sym[code == 94] = 0
    return sym.astype(np.int64), np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(string, subsequence)`` entries with their weights, scaled so
    that every string has length 1 in the kernel's space."""
    sym, own = symbols(strings)
    keys, weights = [], []
    for a, b in _STEPS:
        if len(sym) <= b:
            continue
        ok = np.flatnonzero(own[:-b] == own[b:])
        keys.append((own[ok] << 18) | (sym[ok] << 12) | (sym[ok + a] << 6) | sym[ok + b])
        weights.append(np.full(len(ok), DECAY ** (b - 2)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    weight = np.add.reduceat(weight, at) if len(at) else weight
    own, sub = key[at] >> 18, key[at] & ((1 << 18) - 1)
    norm = np.sqrt(np.bincount(own, weight * weight, len(strings)))
    return own, sub, weight / norm[own]


class Machine:
    """The folded decision: one weight a subsequence, a bias and a sigmoid."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def decide(self, strings: list[str]) -> np.ndarray:
        out = [np.empty(0)]
        for k in range(0, len(strings), 8_000):  # a part at a time bounds the memory
            part = strings[k:k + 8_000]
            own, sub, weight = subsequences(part)
            out.append(np.bincount(own, weight * self.weights[sub], len(part)) + self.bias)
        return np.concatenate(out)

    def raw(self, word_list: list[str]) -> list[float]:
        return self.decide([cleaned(w) for w in word_list]).tolist()

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30)))


def dense(strings: list[str], columns: np.ndarray) -> np.ndarray:
    """Feature rows over the given subsequences."""
    own, sub, weight = subsequences(strings)
    at = np.searchsorted(columns, sub)
    ok = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == sub)
    out = np.zeros((len(strings), len(columns)))
    out[own[ok], at[ok]] = weight[ok]
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows
    inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + c * a.T @ x[inside], c * a.T @ y[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def unlike(bags: list[list[str]]) -> list[list[str]]:
    """One bag of each group of copies (those that share their three strings of
    lowest hash): what only stands in copies of one text is no evidence."""
    seen: dict = {}
    for bag in bags:
        if bag:
            seen.setdefault(tuple(sorted(zlib.crc32(w.encode()) for w in bag)[:3]), bag)
    return list(seen.values())


def grams(s: str) -> set[str]:
    s = "^" + s
    return {s[i:i + n] for n in (4, 5) for i in range(len(s) - n + 1)}


def fit(toxic: list[list[str]], clean: list[list[str]], seed: int = 1) -> Machine | None:
    """Fit on bags of strings; None if either kind is missing."""
    toxic, clean = unlike(toxic), unlike(clean)
    if not toxic or not clean:
        return None
    g = np.random.default_rng(seed)
    nt, nc = len(toxic), len(clean)
    in_clean = Counter(w for bag in clean for w in bag)
    in_toxic = Counter(w for bag in toxic for w in bag)
    gram_toxic: Counter = Counter()
    for bag in toxic:
        gram_toxic.update(set().union(*map(grams, bag)))
    gram_toxic = Counter({x: n for x, n in gram_toxic.items() if n > 1})
    gram_clean: Counter = Counter()
    for bag in clean:
        gram_clean.update(x for x in set().union(*map(grams, bag)) if x in gram_toxic)

    def surprise(t: int, c: int) -> float:
        p = (t + c + 1) / (nt + nc + 2)
        return (t / nt - c / nc) / np.sqrt(p * (1 - p) * (1 / nt + 1 / nc))

    z = {w: max([surprise(in_toxic[w], in_clean[w]), *(surprise(gram_toxic[x], gram_clean[x]) for x in grams(w))]) for w in in_toxic}
    value, picks, machine = z, Counter(), None
    pool = sorted(w for w in in_clean if len(w) > 1)
    negatives = [pool[i] for i in g.permutation(len(pool))[:4000]]
    for turn in range(ROUNDS):
        picks = Counter()
        for bag in toxic:
            # what clean sentences use as often can't be what makes this one toxic
            open_ = [w for w in bag if in_clean[w] / nc < 0.5 * in_toxic[w] / nt and len(w) > 2]
            if open_:
                best = max(open_, key=lambda w: (value.get(w, -9), w))
                if turn or z[best] > 1.5:
                    picks[best] += 1
                # besides the pick: strings that toxic bags hold far more often
                picks.update(w for w in open_ if w != best and surprise(in_toxic[w], in_clean[w]) >= SURE and in_clean[w] / nc < 0.1 * in_toxic[w] / nt)
        if not picks:
            return None
        positives = sorted(picks)
        top = [w for w, _ in picks.most_common(LANDMARKS * 3 // 4)]
        marks = top + negatives[:LANDMARKS - len(top)]
        columns = np.unique(subsequences(marks)[1])
        m = dense(marks, columns)
        kernel = m @ m.T + 1e-3 * np.eye(len(marks))
        low, vec = np.linalg.eigh(kernel)
        root = vec / np.sqrt(low) @ vec.T
        gapped = [w[:i] + chr(97 + int(g.integers(26))) + w[i:] for w in top if len(w) > 3 for i in g.integers(1, len(w), 3)]
        gapped = sorted(w for w in set(gapped) if w not in in_clean)
        rows = positives + gapped + negatives
        x = dense(rows, columns) @ m.T @ root
        y = np.array([1.0] * (len(positives) + len(gapped)) + [-1.0] * len(negatives))
        own = np.sqrt([picks[w] for w in positives])
        weight = np.concatenate([own * len(negatives) / own.sum(), np.full(len(gapped), GAPPED * len(negatives) / max(1, len(gapped))), np.ones(len(negatives))])
        w, bias = svm(x, y, weight)
        folded = np.zeros(1 << 18)
        folded[columns] = m.T @ (root @ w)
        machine = Machine(folded, bias, 1.0, 0.0)
        every = sorted(set(in_toxic) | set(in_clean))
        value = dict(zip(every, machine.decide(every).tolist(), strict=True))
        hard = sorted((w for w in pool if value[w] > -0.5), key=lambda w: -value[w] * in_clean[w])[:2000]
        negatives = sorted(set(hard)) + [w for w in negatives if w not in set(hard)][:4000]
    best = lambda bag: max((value[w] for w in bag), default=-2.0)
    f = np.array([best(b) for b in toxic] + [best(b) for b in clean])
    y = np.array([1.0] * nt + [0.0] * nc)
    cut = threshold(f, y)
    return Machine(machine.weights, machine.bias, SLOPE, -SLOPE * cut)


def threshold(f: np.ndarray, y: np.ndarray) -> float:
    """The decision value that tells the bags apart with fewest errors; of
    those, the middle of the widest gap."""
    order = np.argsort(f, kind="stable")
    f, y = f[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[f[0] - 1], f, [f[-1] + 1]])
    gap = np.diff(edges)
    at = int(np.argmax(np.where((errors == errors.min()) & (gap > 0), gap, -1.0)))
    return float((edges[at] + edges[at + 1]) / 2)


def joined_letters(codes: np.ndarray, single: np.ndarray, off: np.ndarray, letters: list[str]) -> tuple[list[str], list[int]]:
    """Runs of three or more words of one letter each, joined, and their text."""
    hit = single[codes].astype(np.int8)
    if not hit.any():
        return [], []
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(hit)
    fresh = np.concatenate([[True], (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(at)))
    out, own = [], []
    for b, n in zip(begin[size >= 3], size[size >= 3], strict=True):
        out.append("".join(letters[c] for c in codes[at[b:b + n]]))
        own.append(int(doc[at[b]]))
    return out, own


def strings_of(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, list[str], list[int]]:
    """Coded words of the texts, the distinct words, offsets, and the joined
    runs of single letters with the text of each."""
    codes, distinct, off = words(text)
    short = pc.less_equal(pc.utf8_length(distinct), 3).to_numpy(zero_copy_only=False)
    single, letters = np.zeros(len(distinct), bool), [""] * len(distinct)
    for i in np.flatnonzero(short):
        c = cleaned(distinct[int(i)].as_py())
        if len(c) == 1:
            single[i], letters[i] = True, c
    return codes, distinct, off, *joined_letters(codes, single, off, letters)


def training_bags(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[list, list]:
    """Bags of distinct strings of at most ``toxic`` and ``clean`` labelled
    documents (chosen by hash of the id), SAMPLE_STRINGS strings each at most
    (evenly spread over the text); for the driver."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(23))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).join(
        docs.select("doc_id"), "doc_id", "left_semi")
    pick = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    chosen = pick[0].unionByName(pick[1]).dropDuplicates(["doc_id"])  # its size is bounded by the two limits

    def bags(batches):
        for b in batches:
            out = []
            for text in texts(b).to_pylist():
                _, distinct, _, extra, _ = strings_of(pa.array([text], pa.string()))
                own = sorted({cleaned(w) for w in distinct.to_pylist()} | set(extra))
                own = [w for w in own if len(w) > 1]
                if len(own) > SAMPLE_STRINGS:
                    own = [own[i * len(own) // SAMPLE_STRINGS] for i in range(SAMPLE_STRINGS)]
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.list_(pa.string()))], ["toxic", "bag"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.select("toxic", "text").mapInArrow(bags, "toxic int, bag array<string>")
    out: tuple[list, list] = ([], [])
    for r in got.toLocalIterator():
        out[r.toxic != 1].append(tuple(sys.intern(w) for w in r.bag))
    return sorted(out[0]), sorted(out[1])


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Fit on ``docs`` rows that ``labels`` (doc_id, toxic) marks.  Null labels
    and ids are left out; None if a kind is missing."""
    on_workers(docs.sparkSession)
    return fit(*training_bags(docs, labels))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``.

    Null and empty texts, and all texts if nothing could be learned, get the
    score of having no string.  Repeated rows give repeated rows, further
    columns are ignored, an empty table gives an empty result, texts of any
    length are scored whole.
    """
    spark = on_workers(docs.sparkSession)
    sent = spark.sparkContext.broadcast(machine)

    def task():
        m = sent.value
        # the table belongs to the machine that filled it
        key = None if m is None else hash((m.bias, m.slope, m.shift, float(m.weights.sum())))
        table = None if m is None else in_worker(("toxic", key), lambda: Remembered(m.raw))

        def part(batch):
            text = texts(batch)
            best = np.full(len(text), -2.0)
            if m is not None:
                codes, distinct, off, extra, own = strings_of(text)
                value = np.array(table.get(distinct.to_pylist()), float)
                some = np.flatnonzero(np.diff(off))
                if len(some):
                    best[some] = np.maximum(best[some], np.maximum.reduceat(value[codes], off[some]))
                if extra:
                    np.maximum.at(best, own, m.decide(extra))
            p = m.probability(best) if m is not None else np.zeros(len(text))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
        return part

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_slices(docs, "text", with_id(docs, "score double, predicted int"), task)


def kept(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`score` does not
    predict to be toxic."""
    scored = score(docs.select(F.struct("*").alias("doc_id"), "text"), machine)
    return scored.where("predicted = 0").select("doc_id.*")
