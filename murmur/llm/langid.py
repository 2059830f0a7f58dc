"""Language identification with a bidirectional gated recurrent network over
bytes.

Each direction has one update gate: ``z = sigmoid(A_z[byte] + h U_z)``,
``c = tanh(A_c[byte] + h U_c)``, ``h += z * (c - h)``.  Both states together
give language probabilities at every byte; a document's are the mean over all
its bytes.  Texts are read whole, cut into spans of ``SPAN`` bytes, and the
spans of a slice run through numpy side by side.  Training is backpropagation
through time in numpy on the driver, over a bounded sample of spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import map_slices, on_workers, texts, with_id

#: Bytes in a span, hidden units a direction, spans side by side.
SPAN, HIDDEN, SIDE = 128, 8, 2048
#: The training sample's bound: documents a language, spans a document.
SAMPLE_DOCS, SAMPLE_SPANS = 500, 6


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts (bytes joined, offsets) into rows of SPAN bytes, zero padded:
    the rows, the text of each and its bytes in use."""
    size = np.diff(off)
    count = -(-size // SPAN)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = off[owner] + nth * SPAN
    used = np.minimum(SPAN, off[owner + 1] - begin)
    at = begin[:, None] + np.arange(SPAN)
    rows = np.append(data, np.zeros(SPAN, np.uint8))[np.minimum(at, len(data) + SPAN - 1)]
    rows[np.arange(SPAN) >= used[:, None]] = 0
    return rows, owner, used


class Network:
    """Parameters and passes.  ``A``: (2, 256, 2H) input tables, ``U``: (2, H,
    2H) recurrent weights, ``V``, ``c``: output layer; first index: direction."""

    def __init__(self, languages: list[str], seed: int = 3):
        g = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"A": g.normal(0, 0.3, (2, 256, 2 * HIDDEN)), "U": g.normal(0, 0.3, (2, HIDDEN, 2 * HIDDEN)),
                  "V": g.normal(0, 0.3, (2 * HIDDEN, len(languages))), "c": np.zeros(len(languages))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, rows: np.ndarray, keep: bool = False):
        """States (time, direction, row, unit) and, for training, the gates.
        Entry ``t`` of the second direction belongs to byte ``SPAN-1-t``."""
        a, u = self.p["A"], self.p["U"]
        n, t_all = rows.shape
        half = np.float32(0.5)
        scale = np.ones(2 * HIDDEN, np.float32)
        scale[:HIDDEN] = half  # sigmoid(x) = (1 + tanh(x / 2)) / 2: one tanh for both parts
        a, u = a * scale, u * scale
        forth, back = np.ascontiguousarray(rows.T), np.ascontiguousarray(rows.T[::-1])
        h = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((t_all, 2, n, HIDDEN), np.float32)
        gates = np.empty((t_all, 2, n, 2 * HIDDEN), np.float32) if keep else None
        y = np.empty((2, n, 2 * HIDDEN), np.float32)
        for t in range(t_all):
            np.matmul(h, u, out=y)
            y[0] += a[0].take(forth[t], axis=0)
            y[1] += a[1].take(back[t], axis=0)
            np.tanh(y, out=y)
            z = y[..., :HIDDEN] * half
            z += half
            step = y[..., HIDDEN:] - h
            step *= z
            h = h + step
            out[t] = h
            if keep:
                gates[t, ..., :HIDDEN], gates[t, ..., HIDDEN:] = z, y[..., HIDDEN:]
        return out, gates

    def outputs(self, out: np.ndarray) -> np.ndarray:
        """Language probabilities (time, row, language)."""
        v = self.p["V"]
        x = out[:, 0] @ v[:HIDDEN]
        x += out[::-1, 1] @ v[HIDDEN:]
        x += self.p["c"]
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        return x

    def pooled(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text (zeros if it has no byte)."""
        rows, owner, used = spans(data, off)
        total = np.zeros((len(off) - 1, len(self.languages)))
        for i in range(0, len(rows), SIDE):
            part = rows[i:i + SIDE]
            p = self.outputs(self.states(part)[0])
            p *= (np.arange(SPAN)[:, None] < used[i:i + SIDE])[..., None]
            np.add.at(total, owner[i:i + SIDE], p.sum(0, dtype=np.float64))
        return total / np.maximum(np.diff(off), 1)[:, None]

    def gradients(self, rows: np.ndarray, used: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy of all bytes."""
        out, gates = self.states(rows, keep=True)
        d = self.outputs(out)
        n, t_all = rows.shape
        mask = (np.arange(t_all)[:, None] < used)[..., None]
        d[:, np.arange(n), label] -= 1
        d *= mask / np.float32(used.sum())
        v, u = self.p["V"], self.p["U"]
        flat = d.reshape(-1, d.shape[-1])
        g = {"V": np.concatenate([out[:, 0].reshape(-1, HIDDEN).T @ flat, out[::-1, 1].reshape(-1, HIDDEN).T @ flat]),
             "c": flat.sum(0), "A": np.zeros_like(self.p["A"]), "U": np.zeros_like(u)}
        into = np.stack([d @ v[:HIDDEN].T, (d @ v[HIDDEN:].T)[::-1]], 1)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        order = (rows.T, rows.T[::-1])
        for t in range(t_all - 1, -1, -1):
            dh = dh + into[t]
            z, c = gates[t, ..., :HIDDEN], gates[t, ..., HIDDEN:]
            prev = out[t - 1] if t else np.zeros_like(dh)
            pre = np.concatenate([dh * (c - prev) * z * (1 - z), dh * z * (1 - c * c)], -1)
            for k in (0, 1):
                np.add.at(g["A"][k], order[k][t], pre[k])
            g["U"] += prev.transpose(0, 2, 1) @ pre
            dh = dh * (1 - z) + pre @ u.transpose(0, 2, 1)
        return g

    def fit(self, rows: np.ndarray, used: np.ndarray, label: np.ndarray, epochs: int = 4, side: int = 256, rate: float = 0.02):
        """Adam over shuffled batches, languages weighted alike by the sample."""
        g = np.random.default_rng(5)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps = max(120, epochs * len(rows) // side)
        for step in range(1, steps + 1):
            pick = g.integers(0, len(rows), min(side, len(rows)))
            grad = self.gradients(rows[pick], used[pick], label[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
            now = rate * (1 - 0.9 * step / steps)
            for k, x in grad.items():
                x = x / max(1.0, norm)
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= (now * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def as_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets."""
    size = pc.binary_length(text).to_numpy(zero_copy_only=False)
    data = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8)
    return data, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def training_spans(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(lang, span binary)``: at most ``sample_docs`` distinct texts a language
    (by hash) and SAMPLE_SPANS spans of each, spread over the text."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    counts = rows.groupBy("lang").count()  # one row a language
    draw = F.xxhash64("text", F.lit(11)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    some = rows.join(F.broadcast(counts), "lang").withColumn("draw", draw)
    # a text counts once, however many rows repeat it (they are told apart by nothing)
    some = some.where(F.col("draw") < 1.5 * sample_docs / F.col("count")).groupBy("lang", "text").agg(F.first("draw").alias("draw"))

    def cut(batches):
        for b in batches:
            lang, out, draws = [], [], []
            for name, text, d in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "draw")), strict=True):
                raw = text.encode()
                for k in range(SAMPLE_SPANS):
                    at = max(0, len(raw) - SPAN) * k // max(1, SAMPLE_SPANS - 1)
                    lang.append(name)
                    out.append(raw[at:at + SPAN])
                    draws.append(d)
                    if len(raw) <= SPAN:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary()), pa.array(draws, pa.float64())], ["lang", "span", "draw"])

    spans_ = some.mapInArrow(cut, "lang string, span binary, draw double")
    first = Window.partitionBy("lang").orderBy("draw", "span")
    return (spans_.withColumn("nth", F.row_number().over(first))
            .where(F.col("nth") <= sample_docs * SAMPLE_SPANS).select("lang", "span"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Fit on the sample; None if no row has both a text and a language."""
    on_workers(docs.sparkSession)
    got = sorted((r.lang, bytes(r.span)) for r in training_spans(docs, sample_docs).collect())
    if not got:
        return None
    languages = sorted({x for x, _ in got})
    raw = np.frombuffer(b"".join(s for _, s in got), np.uint8)
    rows, owner, used = spans(raw, np.concatenate([[0], np.cumsum([len(s) for _, s in got])]))
    label = np.array([languages.index(x) for x, _ in got])[owner]
    return Network(languages).fit(rows, used, label)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row: the most probable learned
    language and its pooled probability.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    could be learned.  Equal probabilities go to the first language by name.
    Repeated rows give repeated rows, further columns are ignored, an empty
    table gives an empty result, texts of any length are read whole.
    """
    spark = on_workers(docs.sparkSession)
    sent = spark.sparkContext.broadcast(network)

    def task():
        net = sent.value

        def part(batch):
            text = texts(batch)
            some = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            name, score = np.array(["und"] * len(text), object), np.zeros(len(text))
            if net is not None and some.any():
                p = net.pooled(*as_bytes(text.filter(pa.array(some))))
                name[some] = np.array(net.languages, object)[p.argmax(1)]
                score[some] = np.clip(p.max(1), 0, 1)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        return part

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_slices(docs, "text", with_id(docs, "lang_pred string, score double"), task)


def kept(docs: DataFrame, network: Network | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`identify` gives
    a language with a score of ``least`` or more.  Without a network all rows
    with a letter stay."""
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = identify(docs.select(F.struct("*").alias("doc_id"), "text"), network)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("doc_id.*")
