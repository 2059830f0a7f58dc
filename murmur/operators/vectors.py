"""Vector maths on word and message vectors.

* :class:`Standardizer` - column mean / population std (zero-variance safe),
  fitted by one distributed aggregate; the ``dim``-sized result is the model.
* :func:`message_vector_blocks` - per message, the median and std of its word
  vectors per dimension, std of shifted token differences (``diff0``) and
  median/std of circularly shifted dimension differences (``diff1``).
* :func:`nearest_words`, :func:`cosmul` - similarity search of a few probe
  sets against a whole vocabulary (probe vectors inlined, top-k merged).
* :func:`augment_with_neighbours` - each message's top-n nearest words
  (brute force, blocks of messages against blocks of the vocabulary).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators.topk import top_k_per_group

# words or messages in a block of the brute-force neighbour search
BLOCK_ROWS = 2048
#: Words of a block of the vocabulary, messages that meet it at once.
VOCAB_ROWS, TOGETHER = 1 << 15, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


class Standardizer:
    """``z = (x - mean) / std`` per dimension with the population std; a
    zero std scales by 1 (as scikit-learn does)."""

    def __init__(self, mean: list[float], std: list[float]):
        self.mean, self.std = mean, std

    @classmethod
    def fit(cls, df: DataFrame, vec_col: str) -> "Standardizer":
        long = df.select(F.posexplode_outer(vec_col).alias("dim", "x")).filter(F.col("dim").isNotNull())
        stats = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("dim")
        rows = stats.collect()  # one row per dimension: the model
        return cls([r["m"] for r in rows], [r["s"] if r["s"] else 1.0 for r in rows])

    def transform(self, df: DataFrame, vec_col: str, out: str | None = None) -> DataFrame:
        m = F.array(*[F.lit(float(x)) for x in self.mean])
        s = F.array(*[F.lit(float(x)) for x in self.std])
        z = F.zip_with(F.zip_with(F.col(vec_col), m, lambda x, a: x - a), s, lambda x, b: x / b)
        return df.withColumn(out or vec_col, z)


def block_names(d0: int = 1, d1: int = 5) -> list[tuple[str, str, str, int]]:
    """(name, kind, stat, shift) of every block, in feature order."""
    blocks = [("avg", "base", "median", 0), ("std", "base", "std", 0)]
    blocks += [(f"diff0_std_{i}", "diff0", "std", i) for i in range(1, d0)]
    blocks += [(label.format(i), "diff1", stat, i) for i in range(1, d1) for label, stat in (("diff1_{}", "median"), ("diff1_std_{}", "std"))]
    return [(f"{place:02d}_{label}", *rest) for place, (label, *rest) in enumerate(blocks)]


def feature_slice(features: Column | str, start: int, stop: int) -> Column:
    """Columns ``start`` to ``stop`` (exclusive) of a feature array."""
    return F.slice(features, start + 1, stop - start)


def block_coordinates(size: int, d0: int = 1, d1: int = 5) -> dict[str, tuple[int, int]]:
    """Where each block lies in the feature array: name -> ``(start, stop)``."""
    return {name: (k * size, (k + 1) * size) for k, (name, *_) in enumerate(block_names(d0, d1))}


def feature_rows(blocks: DataFrame, id_col: str = "doc_id", out: str = "features") -> DataFrame:
    """``(doc_id, features array<double>)``: a message's blocks side by side."""
    rows = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("block", "dim", "value"))).alias("_c"))
    return rows.select(id_col, F.transform("_c", lambda c: c["value"]).alias(out))


def message_vector_blocks(token_vectors: DataFrame, messages: DataFrame | None = None,
                          d0: int = 1, d1: int = 5, size: int | None = None,
                          id_col: str = "doc_id", pos_col: str = "pos",
                          vec_col: str = "vector") -> DataFrame:
    """``(doc_id, block, dim, value)`` for every block of :func:`block_names`.

    ``token_vectors`` holds the vectors of a message's known words in token
    order.  Vectors are gathered once per message (a message is bounded by its
    text) and reduced by numpy in one pass over the gathered matrix; no row per
    token and dimension is made.  Messages of ``messages`` without any known
    word get zero blocks.
    """
    g = token_vectors.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(vec_col).alias("v")))).alias("_pv"))
    g = g.select(id_col, F.flatten(F.transform("_pv", lambda s: s["v"])).alias("_x"), F.size("_pv").alias("_n"))
    names = block_names(d0, d1)

    def reduce(batches):
        for b in batches:
            at, block, values = [], [], []
            for r, n in enumerate(b.column("_n").to_pylist()):
                m = b.column("_x")[r].values.to_numpy(zero_copy_only=False).reshape(n, -1)
                for name, kind, stat, shift in names:
                    d = m
                    if kind == "diff1":
                        d = m - np.roll(m, shift, axis=1)
                    elif kind == "diff0":
                        # too short for the shift: one zero row, whose std is the zero block
                        d = np.diff(m - np.roll(m, shift, axis=0), axis=0) if n > shift else np.zeros((1, m.shape[1]))
                    at.append(r)
                    block.append(name)
                    values.append(np.median(d, axis=0) if stat == "median" else d.std(axis=0))
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).take(pa.array(at, pa.int64())), pa.array(block, pa.string()), pa.array(values, pa.list_(pa.float64()))],
                [id_col, "block", "_v"])

    schema = T.StructType([g.schema[id_col], T.StructField("block", T.StringType()), T.StructField("_v", T.ArrayType(T.DoubleType()))])
    out = (g.mapInArrow(reduce, schema).select(id_col, "block", F.posexplode_outer("_v").alias("dim", "value"))
           .filter(F.col("dim").isNotNull()).withColumn("dim", F.col("dim").cast("long")))
    out = out.select(id_col, "block", "dim", "value")
    if messages is not None:
        if size is None:
            raise ValueError("size is needed to fill messages without vectors")
        empty = messages.select(id_col).join(g.select(id_col), id_col, "left_anti")
        zero = empty.select(id_col, F.explode(F.array(*[F.lit(nm) for nm, *_ in names])).alias("block"),
                            F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("dim"))
        out = out.unionByName(zero.select(id_col, "block", F.col("dim").cast("long"), F.lit(0.0).alias("value")))
    return out


def _probe_vectors(words: DataFrame, probes: list[str], word_col: str, vec_col: str) -> dict[str, list[float]]:
    rows = words.filter(F.col(word_col).isin(probes)).select(word_col, vec_col).collect()  # bounded by probes
    return {r[0]: list(r[1]) for r in rows}


def _unit_np(v):
    v = np.asarray(v, dtype=np.float64)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def nearest_words(words: DataFrame, probes: list[list[str]], topn: int = 10,
                  word_col: str = "word", vec_col: str = "vector") -> DataFrame:
    """``(probe, rank, word, sim)``: for each probe word set, the ``topn``
    words most similar to the normalised mean of its unit vectors (words of
    the set excluded; unknown probe words skipped)."""
    flat = sorted({w for p in probes for w in p})
    known = _probe_vectors(words, flat, word_col, vec_col)
    out = None
    uv = words.select(word_col, unit(F.col(vec_col)).alias("_u"))
    for pi, p in enumerate(probes):
        vecs = [_unit_np(known[w]) for w in p if w in known]
        if not vecs:
            continue
        q = _unit_np(np.mean(vecs, axis=0))
        qc = F.array(*[F.lit(float(x)) for x in q])
        scored = uv.filter(~F.col(word_col).isin(p)).select(
            F.lit(pi).alias("probe"), word_col, dot(F.col("_u"), qc).alias("sim"))
        top = top_k_per_group(scored, ["probe"], [F.col("sim").desc(), F.col(word_col)], topn,
                              salt_cols=[word_col])
        out = top if out is None else out.unionByName(top)
    return out


def cosmul(words: DataFrame, positive: list[str], negative: list[str], topn: int = 10,
           word_col: str = "word", vec_col: str = "vector") -> DataFrame:
    """3CosMul: ``prod((1 + cos(w, p)) / 2) / (prod((1 + cos(w, n)) / 2) + 1e-6)``
    over known probe words; probe words excluded; ``(rank, word, score)``."""
    known = _probe_vectors(words, sorted(set(positive + negative)), word_col, vec_col)
    pos = [_unit_np(known[w]) for w in positive if w in known]
    neg = [_unit_np(known[w]) for w in negative if w in known]
    u = unit(F.col(vec_col))
    uv = words.filter(~F.col(word_col).isin(positive + negative)).select(word_col, u.alias("_u"))

    def term(q):
        return (F.lit(1.0) + dot(F.col("_u"), F.array(*[F.lit(float(x)) for x in q]))) / 2

    num = F.lit(1.0)
    for q in pos:
        num = num * term(q)
    den = F.lit(1.0)
    for q in neg:
        den = den * term(q)
    scored = uv.select(F.lit(0).alias("probe"), word_col, (num / (den + F.lit(1e-6))).alias("score"))
    return top_k_per_group(scored, ["probe"], [F.col("score").desc(), F.col(word_col)], topn,
                           salt_cols=[word_col]).drop("probe")


def augment_with_neighbours(token_words: DataFrame, words: DataFrame, topn: int = 10,
                            id_col: str = "doc_id", word_col: str = "word",
                            vec_col: str = "vector") -> DataFrame:
    """``(doc_id, rank, word, sim)``: per message, the ``topn`` vocabulary
    words nearest the normalised mean of its known words' unit vectors,
    excluding its own words.

    Brute force over the whole vocabulary (exact), in blocks of both sides:
    blocks of messages meet every block of the vocabulary, each meeting yields a
    top-n per message, and the last top-n merges those.  A block of messages
    travels once for every ``VOCAB_ROWS`` words.  Neither side passes through the driver.
    """
    u = unit(F.col(vec_col))
    vocab = words.select(F.col(word_col).alias("w"), u.alias("u")).withColumn("r", F.struct("w", "u"))
    n_blocks = max(1, -(-words.count() // VOCAB_ROWS))
    vocab = (vocab.groupBy(F.pmod(F.xxhash64("w"), F.lit(n_blocks)).alias("_vb")).agg(F.collect_list("r").alias("r"))
             .select("_vb", F.transform("r", lambda x: x["w"]).alias("_names"), F.flatten(F.transform("r", lambda x: x["u"])).alias("_mat"),
                     F.size(F.col("r")[0]["u"]).alias("_dim")))
    known = token_words.join(words.select(word_col, u.alias("_u")), word_col)
    per_doc = known.groupBy(id_col).agg(F.collect_list(F.struct(F.col(word_col).alias("w"), F.col("_u").alias("u"))).alias("r"))
    per_doc = per_doc.select(id_col, F.transform("r", lambda x: x["w"]).alias("_own"), F.transform("r", lambda x: x["u"]).alias("_vs"))
    # messages are dealt to blocks that grow in number, not in size
    n_messages = token_words.select(F.approx_count_distinct(id_col)).first()[0]
    blocks = max(1, -(-n_messages // BLOCK_ROWS))
    asked = (per_doc.withColumn("_mb", F.pmod(F.xxhash64(id_col), F.lit(blocks)))
             .groupBy("_mb").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "_own", "_vs")).alias("_q"))
             .withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names = np.array(batch.column("_names")[i].as_py(), dtype=object)
                mat = batch.column("_mat")[i].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
                index = {w: j for j, w in enumerate(names)}
                ids, ws, ss = [], [], []
                asking = batch.column("_q")[i].as_py()
                for lo in range(0, len(asking), TOGETHER):
                    part = asking[lo:lo + TOGETHER]
                    # equal vectors tie, wherever they lie in the matrix
                    every = np.round(np.stack([_unit_np(np.array(row["_vs"]).mean(axis=0)) for row in part]) @ mat.T, 12)
                    for row, sims in zip(part, every, strict=True):
                        sims[[index[w] for w in row["_own"] if w in index]] = -np.inf
                        k = min(topn, int(np.isfinite(sims).sum()))
                        # the k-th value and its ties, so that ties go by word below
                        cand = np.flatnonzero(np.isfinite(sims) & (sims >= np.partition(sims, -k)[-k])) if k else ()
                        ids += [row["id"]] * len(cand)
                        ws += [names[j] for j in cand]
                        ss += [float(sims[j]) for j in cand]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(ws, pa.string()), pa.array(ss, pa.float64())], [id_col, "word", "sim"])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(per_doc.schema[id_col].dataType)
    schema = T.StructType([T.StructField(id_col, per_doc.schema[id_col].dataType),
                           T.StructField("word", T.StringType()), T.StructField("sim", T.DoubleType())])
    cand = asked.join(vocab, "_vb").select("_q", "_names", "_mat").mapInArrow(score, schema)
    # a message has few candidates: topn a block of the vocabulary
    w = Window.partitionBy(id_col).orderBy(F.col("sim").desc(), "word")
    return cand.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= topn)


def libsvm_line(label01: Column, features: Column) -> Column:
    """``-1|+1 1:%f 2:%f ...`` (dense, 1-based), label ``int((y - .5) * 2)``."""
    lab = ((label01.cast("double") - 0.5) * 2).cast("int").cast("string")
    items = F.transform(features, lambda x, i: F.format_string("%d:%f", i + 1, x))
    return F.concat_ws(" ", lab, F.array_join(items, " "))


def word_vector_line(word: Column, vec: Column) -> Column:
    """``word,%.8f,%.8f,...``"""
    return F.concat_ws(",", word, F.array_join(F.transform(vec, lambda x: F.format_string("%.8f", x)), ","))


def nested_feature_sets(blocks: DataFrame, experiment_nums: list[int] | None = None,
                        id_col: str = "doc_id") -> DataFrame:
    """Nested feature sets over message-vector blocks: the set named ``n``
    holds every column from 0 up to the end of block ``n`` (blocks ordered by
    their two-digit prefix), optionally only for the listed prefixes.
    ``(doc_id, feature_set, n_features, l2)`` per message and set."""
    b = blocks.withColumn("_ord", F.substring("block", 1, 2).cast("int"))
    names = b.select(F.col("block").alias("feature_set"), F.col("_ord").alias("_set_ord")).distinct()
    if experiment_nums is not None:
        names = names.filter(F.col("_set_ord").isin(list(experiment_nums)))
    # one row per block name: a bounded table
    per = b.groupBy(id_col, "_ord").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("value") * F.col("value")).alias("_ss"))
    joined = per.join(F.broadcast(names), F.col("_ord") <= F.col("_set_ord"))
    return joined.groupBy(id_col, "feature_set").agg(
        F.sum("_k").cast("long").alias("n_features"), F.sqrt(F.sum("_ss")).alias("l2"))


def nearest_to_vectors(words: DataFrame, queries: list[tuple[int, list[float]]], topn: int,
                       word_col: str = "word", vec_col: str = "vector") -> DataFrame:
    """``(query, rank, word, sim)``: cosine top-``topn`` words for each of a
    bounded set of query vectors (e.g. cluster centres), scored in one scan
    with the queries inlined; salted top-k per query."""
    qs = F.array(*[F.struct(F.lit(int(q)).alias("q"),
                            F.array(*[F.lit(float(x)) for x in _unit_np(v)]).alias("c")) for q, v in queries])
    u = words.select(word_col, unit(F.col(vec_col)).alias("_u"))
    scored = u.select(word_col, F.explode(F.transform(qs, lambda s: F.struct(
        s["q"].alias("query"), dot(F.col("_u"), s["c"]).alias("sim")))).alias("_s")) \
        .select("_s.query", word_col, "_s.sim")
    return top_k_per_group(scored, ["query"], [F.col("sim").desc(), F.col(word_col)], topn, salt_cols=[word_col])


def group_centres(df: DataFrame, group_col: str, vec_col: str = "vector", max_groups: int = 10_000):
    """Mean vector per group, collected as the (bounded) model."""
    cells = df.select(group_col, F.posexplode(vec_col).alias("dim", "x"))
    means = cells.groupBy(group_col, "dim").agg(F.avg("x").alias("m"))
    per = means.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_p"))
    rows = per.limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError("too many groups for inlined centres")
    return [(r[group_col], [s["m"] for s in r["_p"]]) for r in rows]
