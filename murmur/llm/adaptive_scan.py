"""Nearest neighbours by inner product with an adaptive dimension scan.

Largest inner product becomes least distance by one more coordinate: with M the
greatest length, ``|q|^2 + M^2 - 2 q.x`` is the squared distance of ``(q, 0)``
and ``(x, sqrt(M^2 - |x|^2))``.  These vectors get a random rotation, after
which a prefix of the coordinates is a fair sample of the distance.

Vectors lie in inverted lists around centroids.  A query scans the lists of the
nearest centroids, in blocks of columns: after each block a candidate is given
up if its partial distance, scaled to all columns, is above the distance of the
k-th best so far by more than a test allows that expects an error with
probability shrinking in the columns seen.  Survivors are ranked by the exact
inner product of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import written
from murmur.llm.vectors import matrix, moments, usable

#: Vectors that centroids are fitted on, share of lists that a query probes,
#: columns in a block, the test's width, vectors in a part of a list, queries
#: that scan it together.
SAMPLE, PROBE, COLUMNS, WIDTH, PART, TOGETHER = 10_000, 0.85, 16, 2.1, 4096, 1024


def rotation(d: int, seed: int = 29) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def k_means(x: np.ndarray, k: int, seed: int = 31, rounds: int = 8) -> np.ndarray:
    g = np.random.default_rng(seed)
    c = x[g.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    d = (c * c).sum(1) - 2 * x @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def raised(v: np.ndarray, most: float, turn: np.ndarray) -> np.ndarray:
    """Rotated vectors with the coordinate that evens out their lengths."""
    rest = np.sqrt(np.maximum(0, most - (v * v).sum(1)))
    return np.hstack([v, rest[:, None]]) @ turn


def scan(q: np.ndarray, q_turned: np.ndarray, q_ids: np.ndarray, x: np.ndarray, turned: np.ndarray, ids: np.ndarray, k: int):
    """The best k of a part of a list for each of some queries, as three arrays:
    place of the query, id found, inner product.  A candidate is alive for a
    query until a test gives it up; one that no query holds on to is dropped."""
    order = np.argsort(ids, kind="stable")
    x, turned, ids = x[order], turned[order], ids[order]
    d = turned.shape[1]
    alive = q_ids[:, None] != ids
    part = np.zeros(alive.shape)
    bound = None
    for lo in range(0, d, COLUMNS):
        hi = min(d, lo + COLUMNS)
        a, b = q_turned[:, lo:hi], turned[:, lo:hi]
        part += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
        if lo == 0 and len(ids) > 4 * k:
            # the candidates nearest so far give a first k-th best distance
            guess = np.where(alive, part, np.inf)
            first = np.argpartition(guess, 2 * k, axis=1)[:, :2 * k]
            full = ((turned[first] - q_turned[:, None, :]) ** 2).sum(2)
            full[~np.take_along_axis(alive, first, 1)] = np.inf
            bound = np.partition(full, k - 1, axis=1)[:, k - 1:k]
        if hi < d and bound is not None:
            alive &= part * (d / hi) <= bound * (1 + WIDTH / np.sqrt(hi)) ** 2
            some = alive.any(0)
            if some.mean() < 0.7:
                alive, part, turned, x, ids = alive[:, some], part[:, some], turned[some], x[some], ids[some]
    score = np.where(alive, q @ x.T, -np.inf)
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
        alive &= score >= least
    row, col = np.nonzero(alive)
    value = score[row, col]
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return row[keep], ids[col[keep]], value[keep]


def search(table: DataFrame, queries, k: int = 20, column: str = "embedding", probe: float = PROBE, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that the condition
    ``queries`` selects, its ``k`` nearest other rows found, by inner product in
    double precision, ties to the smaller id.

    Rows that :func:`usable` leaves out take no part on either side.  Rows with
    equal ids never find each other; query rows with equal ids each have a
    ranking of their own, all under that id.  Fewer candidates than ``k`` are all
    returned.  Further columns are ignored, an empty table gives an empty result.
    ``probe`` is the share of lists that a query scans (1: all), or more where
    those hold fewer than ``k`` candidates.
    """
    spark = table.sparkSession
    # written once, so the number of a row is settled
    rows = written(usable(table, column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    _, most = moments(rows, "v")
    n = rows.count()
    lists = int(np.clip(round(np.sqrt(n) / 8), 16, 4096))
    share = (F.xxhash64("vec_id", F.lit(3)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < 1.2 * sample / max(1, n)
    some = [r.v for r in rows.where(share).orderBy("vec_id").limit(sample).collect()] or [r.v for r in rows.limit(sample).collect()]
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = np.array(some)
    turn = rotation(some.shape[1] + 1)
    centroids = k_means(raised(some, most, turn), min(lists, len(some)))
    lists = len(centroids)
    probes = max(1, min(lists, int(np.ceil(probe * lists))))

    def home(batches):
        for b in batches:
            x = matrix(b.column("v"))
            if len(x):
                at = nearest(raised(x, most, turn), centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(at.astype(np.int32))], ["vec_id", "v", "list"])

    placed = written(rows.mapInArrow(home, "vec_id long, v array<double>, list int"), "lists")
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # at most 4096 rows
        held[r["list"]] = r["count"]
    sizes = placed.groupBy("list").count().select("list", F.ceil(F.col("count") / PART).cast("int").alias("parts"))  # at most 4096 rows

    def pack(t: pa.Table) -> pa.Table:
        # large lists are dealt to parts, so none is one task's
        x = matrix(t.column("v").combine_chunks())
        return pa.table({"list": t.column("list")[:1], "part": t.column("part")[:1], "ids": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()),
                         "x": pa.array([x.tobytes()], pa.binary()), "turned": pa.array([raised(x, most, turn).tobytes()], pa.binary())})

    parts = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    parts = written(parts.groupBy("list", "part").applyInArrow(pack, "list int, part int, ids binary, x binary, turned binary"), "parts")

    def route(batches):
        for b in batches:
            x = matrix(b.column("v"))
            if not len(x):
                continue
            to = nearest(np.hstack([x, np.zeros((len(x), 1))]) @ turn, centroids, lists)
            # further lists until there are k candidates, or all
            few = np.cumsum(held[to], axis=1) < k + b.column("same").to_numpy()[:, None]
            probed = np.zeros(to.shape, bool)
            np.put_along_axis(probed, to, np.arange(lists) < np.maximum(probes, few.sum(1) + 1)[:, None], 1)
            ids, rows_ = b.column("vec_id").to_numpy(), b.column("row").to_numpy()
            for i in range(lists):
                own = np.flatnonzero(probed[:, i])
                for k0 in range(0, len(own), TOGETHER):
                    at = own[k0:k0 + TOGETHER]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([v[at].tobytes()], pa.binary()) for v in (rows_, ids, x))],
                                                     ["list", "q_rows", "q_ids", "q"])

    same = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("same"))  # rows that a query can't find
    asked = rows.where(queries).join(same, "vec_id").mapInArrow(route, "list int, q_rows binary, q_ids binary, q binary")

    def meet(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                raw = lambda c: batch.column(c)[r].as_py()  # noqa: E731, B023
                ids, q_ids, q_rows = (np.frombuffer(raw(c), np.int64) for c in ("ids", "q_ids", "q_rows"))
                x, q = np.frombuffer(raw("x")).reshape(len(ids), -1), np.frombuffer(raw("q")).reshape(len(q_ids), -1)
                turned = np.frombuffer(raw("turned")).reshape(len(ids), -1)
                q_turned = np.hstack([q, np.zeros((len(q), 1))]) @ turn
                for k0 in range(0, len(q), 256):
                    at = slice(k0, k0 + 256)
                    row, other, score = scan(q[at], q_turned[at], q_ids[at], x, turned, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_rows[at][row]), pa.array(q_ids[at][row]), pa.array(other), pa.array(score)],
                                                     ["row", "query_id", "vec_id", "score"])

    found = asked.join(parts, "list").mapInArrow(meet, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
