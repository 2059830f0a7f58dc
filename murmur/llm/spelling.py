"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one insertion, deletion or replacement of a code point
parts them, that is if their common prefix and common suffix together reach the
longer length less one.  Words lie in padded code-point matrices, and blocks of
them are compared in pairs, column by column, all rows of one with all rows of
the other.

Which block pairs need comparing is settled by sorting: for a pair whose longer
word has ``L`` code points, its common prefix falls into one of ``PARTS`` ranges,
and from its range follows what prefix and what suffix the pair must share at
least.  Each word is listed under these shared ends (as the longer word, and as
one shorter by one), blocks are cut from the sorted list, and two blocks are
compared where the list goes on from one into the other with the same ends.  A
pair counts in the range its prefix really falls into, so it is found once.

Lists are dealt to buckets of a bounded number of code points.  A list of shared
ends that is too long for a task is dealt to sub-blocks by hash, and each pair of
sub-blocks is a task's work; nothing is left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.blocks import group_count
from murmur.llm.common import U, map_slices, mix, on_workers, runs, texts, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Distinct words a task counts before it sends its counts on.
COUNTED = 200_000
#: Ranges of the common prefix; code points of a bucket, and of a list of words
#: with the same ends that is split; rows of a block and cells compared at once.
PARTS, BUCKET_CHARS, LIST_CHARS = 4, 1 << 20, 1 << 17
BLOCK, CELLS = 32, 1 << 18
#: Long lists are broadcast if there can't be more of them than this (16 bytes each).
LONG_LISTS = 1 << 20


# ---- words ---------------------------------------------------------------------

def forms_of(text: str, doc_id, pattern: re.Pattern, every: int) -> Counter:
    """Words of one text and how often they stand there.  A word whose hash with
    the id ``every`` divides loses a code point, wherever it stands in the text."""
    out = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(pattern.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1:]
        out[word] += n
    return out


def word_counts(docs: DataFrame, least_chars: int, least_n: int, pattern: str = LETTERS, every: int = 31) -> DataFrame:
    """``(word, n long)`` over all documents: counted in each task first, then
    added up, so a word that stands everywhere costs a row a task."""
    def start():
        found, seen = re.compile(pattern), Counter()

        def batch_of(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        def part(batch: pa.RecordBatch):
            for text, doc_id in zip(texts(batch).to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                for word, n in forms_of(text, doc_id, found, every).items():
                    if len(word) >= least_chars:
                        seen[word] += n
                if len(seen) > COUNTED:
                    yield batch_of(seen)
                    seen.clear()
            if seen:
                yield batch_of(seen)
                seen.clear()
        return part

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = map_slices(rows, "text", "word string, n long", start, limit=24 << 20)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# ---- shared ends ---------------------------------------------------------------

def ranges(longer: int) -> list[tuple[int, int, int]]:
    """``(low, high, suffix)``: a pair with a common prefix in ``low..high`` has
    a common suffix of ``suffix`` at least, if it is near."""
    m = longer - 1
    cut = [i * (m + 1) // PARTS for i in range(PARTS + 1)]
    return [(cut[i], cut[i + 1] - 1, m - cut[i + 1] + 1) for i in range(PARTS) if cut[i] < cut[i + 1]]


def matrix(words: list[str], width: int) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), width)


def ends_hash(points: np.ndarray, prefix: int, suffix: int, tag: int) -> np.ndarray:
    h = np.full(len(points), tag, U)
    for c in (*range(prefix), *range(points.shape[1] - suffix, points.shape[1])):
        h = mix(h, points[:, c].astype(U))
    return h


def ends(words: DataFrame) -> DataFrame:
    """``(longer int, part int, ends long, word, n)``: each word under the ends
    it must share with a near word, as the longer one or the shorter one."""
    schema = "longer int, part int, ends long, word string, n long"

    def start():
        def part(batch: pa.RecordBatch):
            names, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            size = np.fromiter(map(len, names), np.int64, len(names))
            for width in np.unique(size).tolist():
                at = np.flatnonzero(size == width)
                some = [names[i] for i in at]
                points, word, count = matrix(some, width), pa.array(some, pa.string()), pa.array(n[at])
                for longer in (width, width + 1):
                    for k, (low, _, suffix) in enumerate(ranges(longer)):
                        key = ends_hash(points, low, suffix, longer * PARTS + k).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), longer, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(key), word, count],
                            ["longer", "part", "ends", "word", "n"])
        return part

    return map_slices(words, "word", schema, start, limit=1 << 20)


# ---- tiles ---------------------------------------------------------------------

def padded(words: list[str], longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of words of ``longer`` or one less code points: aligned left
    and aligned right, the free column zero."""
    left = np.zeros((len(words), longer), np.uint32)
    right = np.zeros((len(words), longer), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    for width in (longer - 1, longer):
        at = np.flatnonzero(size == width)
        if len(at) and width:
            points = matrix([words[i] for i in at], width)
            left[at, :width] = points
            right[at, longer - width:] = points
    kind = np.uint8 if left.max(initial=0) < 256 else np.uint32
    return left.astype(kind), right.astype(kind)


def block_pairs(key: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of blocks of sorted rows that may hold the same key."""
    first = np.arange(0, len(key), block)
    last = np.minimum(first + block, len(key)) - 1
    reach = (np.searchsorted(key, key[last], "right") - 1) // block  # block that the last key goes on to
    count = reach - np.arange(len(first)) + 1
    i = np.repeat(np.arange(len(first)), count)
    return i, i + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def near_rows(words: list[str], longer: int, part: int, key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs ``(i, j)`` among rows sorted by ``key``.  ``side`` tells the
    rows of two sub-blocks apart (1 and 2: only pairs across; 0: all pairs)."""
    low, high, _ = ranges(longer)[part]
    left, right = padded(words, longer)
    full = np.fromiter((len(w) == longer for w in words), bool, len(words))
    block = max(1, min(BLOCK, CELLS // longer))
    blocks = -(-len(words) // block)
    fill = blocks * block - len(words)

    def cut(x):
        return np.concatenate([x, np.zeros((fill, *x.shape[1:]), x.dtype)]).reshape(blocks, block, *x.shape[1:])

    left, right, full, keys, sides = cut(left), cut(right), cut(full), cut(key), cut(side)
    row = np.arange(blocks * block).reshape(blocks, block)
    a, b = block_pairs(key, block)
    step = max(1, CELLS // (block * max(block, longer)))
    found = []
    for lo in range(0, len(a), step):
        x, y = a[lo:lo + step], b[lo:lo + step]

        together = keys[x][:, :, None] == keys[y][:, None, :]

        def common(points, columns, x=x, y=y, together=together):
            alive, total = together.copy(), np.zeros(together.shape, np.uint16 if longer < 1 << 15 else np.int64)
            for c in columns:
                alive &= points[x, :, c][:, :, None] == points[y, :, c][:, None, :]
                if not alive.any():
                    break
                total += alive
            return total

        prefix, suffix = common(left, range(longer)), common(right, range(longer - 1, -1, -1))
        near = together & (prefix + suffix >= longer - 1) & (np.minimum(prefix, longer - 1) >= low) & (np.minimum(prefix, longer - 1) <= high)
        near &= full[x][:, :, None] | full[y][:, None, :]  # two shorter ones belong to another list
        near &= (row[x][:, :, None] < row[y][:, None, :]) & (row[y] < len(words))[:, None, :]
        near &= (sides[x][:, :, None] != sides[y][:, None, :]) | (sides[x] == 0)[:, :, None]
        t, i, j = np.nonzero(near)
        found.append((row[x[t], i], row[y[t], j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def best_of_bucket(table: pa.Table) -> pa.Table:
    """``(word, n_near, n_form, form)`` of the near pairs in one bucket: how many
    near words a word has here, and the one of largest count."""
    order = table.sort_by([("longer", "ascending"), ("part", "ascending"), ("ends", "ascending")])
    longer, part = order.column("longer").to_numpy(), order.column("part").to_numpy()
    key, side = order.column("ends").to_numpy(), order.column("side").to_numpy()
    words, n = order.column("word").to_pylist(), order.column("n").to_numpy()
    edge = runs(longer.astype(np.int64) * PARTS + part)
    src, dst = [], []
    for lo, hi in zip(edge, [*edge[1:], len(words)], strict=True):
        i, j = near_rows(words[lo:hi], int(longer[lo]), int(part[lo]), key[lo:hi], side[lo:hi])
        src += [lo + i, lo + j]
        dst += [lo + j, lo + i]
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("n_form", pa.int64()), ("form", pa.string())])
    if not sum(map(len, src)):
        return schema.empty_table()
    src, dst = np.concatenate(src), np.concatenate(dst)
    # rows of one word (it stands under several ends) come together
    names = sorted(set(words))
    number = {w: k for k, w in enumerate(names)}
    code = np.fromiter((number[w] for w in words), np.int64, len(words))
    src, near, count = code[src], code[dst], n[dst]
    order = np.lexsort((near, -count, src))
    src, near, count = src[order], near[order], count[order]
    first = runs(src)
    return pa.table([[names[k] for k in src[first]], np.diff(np.append(first, len(src))), count[first], [names[k] for k in near[first]]], schema=schema)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, n_form, form)`` of each word that has a near word: how many,
    and the most frequent of them (ties: the least in code-point order).
    ``words``: a written table of distinct ``(word, n)``."""
    spark = on_workers(words.sparkSession)
    listed = ends(words)
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = group_count(2 * PARTS * chars, spark, BUCKET_CHARS)
    # lists too long for a task: no more of them than all code points can fill
    size = F.count(F.lit(1))
    long = (listed.groupBy("ends").agg(F.least(size, F.ceil(size * F.max("longer") / LIST_CHARS)).cast("int").alias("_k"))
            .where(F.col("_k") > 1))
    if 2 * PARTS * (chars + 1) // LIST_CHARS < LONG_LISTS:
        long = F.broadcast(long)
    dealt = listed.join(long, "ends", "left")
    mine = F.pmod(F.xxhash64("word"), F.col("_k")).cast("int")
    # sub-block s meets t: s <= t, as the first side, the second, or both
    meets = F.when(F.col("_k").isNull(), F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("t")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_k") - 1),
                    lambda t: F.struct(F.least(t, F.col("_mine")).alias("s"), F.greatest(t, F.col("_mine")).alias("t"))))
    side = F.when(F.col("_k").isNull() | (F.col("_p.s") == F.col("_p.t")), 0).when(F.col("_p.s") == F.col("_mine"), 1).otherwise(2)
    tiled = (dealt.withColumn("_mine", mine).withColumn("_p", F.explode(meets))
             .select("longer", "part", "ends", "word", "n", side.alias("side"),
                     F.when(F.col("_k").isNull(), F.pmod(F.col("ends"), F.lit(buckets))).otherwise(F.col("ends")).alias("bucket"),
                     F.when(F.col("_k").isNull(), F.lit(-1)).otherwise(F.col("_p.s")).alias("s"), F.col("_p.t").alias("t")))
    found = tiled.groupBy("bucket", "s", "t").applyInArrow(best_of_bucket, "word string, n_near long, n_form long, form string")
    best = F.min(F.struct((-F.col("n_form")).alias("c"), "form"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
            .select("word", "n_near", (-F.col("_b.c")).alias("n_form"), F.col("_b.form").alias("form")))


def variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, ratio: int = 10, pattern: str = LETTERS, every: int = 31) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: each word of at least
    ``least_chars`` code points and ``least_n`` occurrences, the near word of
    largest count if that is ``ratio`` times its own at least (else null), the
    end of the chain of forms, the counts, and the number of near words.

    Null and empty texts have no words; equal rows each count; a null id hashes
    as empty text; no words, no rows; further columns are ignored."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    on_workers(docs.sparkSession)
    words = written(word_counts(docs, least_chars, least_n, pattern, every), "words")
    near = words.join(near_words(words), "word", "left")
    has = F.col("n_form") >= ratio * F.col("n")
    rows = written(near.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(has, F.col("n_form")).alias("form_n")), "forms")
    # counts grow by the ratio along a chain, which bounds its length; following
    # pointers of pointers halves what is left each time
    most = rows.agg(F.max("n")).first()[0] or 1
    links = max(1, int(math.log(max(1.0, most / least_n), ratio) + 1e-9))
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links))):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return (rows.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
