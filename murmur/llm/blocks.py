"""Texts in blocks, for operators that pass over a corpus more than once.

A block holds the texts of some documents, compressed.  The blocks are written
once to the shared folder as a table bucketed by block number, so later joins
of what was found out about a block move only the findings, never the texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import U, grams, hash64, mix, on_workers, scratch, shuffle_partitions, slices, texts, words
from murmur.session import small_batches

#: Bytes of text in a block (a longer single text is a block of its own).
BLOCK_BYTES = 4 << 20


def write_blocks(docs: DataFrame, extra=None, limit: int = BLOCK_BYTES, carry: bool = False, lower: bool = False) -> DataFrame:
    """Table ``(block, doc_id array<long>, size binary, body binary, extra
    binary, rest binary)``.  ``extra(words of the block)`` may add a summary
    (``lower``: of lower-cased words); ``carry`` keeps the other columns of the
    rows, as Arrow bytes, for :func:`rows_of`.  Null texts are empty texts.  Ids
    must be castable to long; null ids stay null."""
    spark = small_batches(on_workers(docs.sparkSession))
    schema = "block long, doc_id array<bigint>, size binary, body binary, extra binary, rest binary"

    def run(batches):
        pid, n = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in slices(batch, "_llm_text", limit):
                text = texts(piece, "_llm_text")
                raw = [t.encode() for t in text.to_pylist()]
                size = np.array([len(x) for x in raw], "<i8")
                more = extra(BlockWords(text, lower)) if extra else b""
                rest = press.compress(stream(piece.drop_columns(["_llm_text", "_llm_id"]))) if carry else b""
                one = lambda x: pa.array([x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(pid << 32) + n]), pa.array([piece.column("_llm_id").to_pylist()], pa.list_(pa.int64())),
                     one(size.tobytes()), one(press.compress(b"".join(raw))), one(more), one(rest)],
                    ["block", "doc_id", "size", "body", "extra", "rest"])
                n += 1

    keep = [c for c in docs.columns if c != "text"] if carry else []
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("_llm_id"), F.col("text").cast("string").alias("_llm_text"))
    return by_block(rows.mapInArrow(run, schema), "none")  # bodies are compressed already


def by_block(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by its column ``block``:
    joins on it need not move its rows."""
    spark = df.sparkSession
    name = f"llm_blocks_{uuid.uuid4().hex[:12]}"
    path = scratch(spark, "blocks", name)
    df.write.bucketBy(shuffle_partitions(spark), "block").option("path", path).option("compression", compression).saveAsTable(name)
    return spark.table(name)


def stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rows_of(rest: bytes) -> pa.Table:
    """The other columns of a block's rows."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(rest)).read_all()


def unpack(size: bytes, body: bytes) -> pa.Array:
    """The texts of a block."""
    n = np.frombuffer(size, "<i8")
    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(n.sum())))
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw)]).cast(pa.string())


class BlockWords:
    """Words of the texts of a block, one after the other: their codes, the
    distinct words, a 64-bit hash and the text of each."""

    def __init__(self, text: pa.Array, lower: bool = False):
        self.codes, self.distinct, self.off = words(text, lower)
        self.hash = hash64(self.distinct)[self.codes] if len(self.codes) else np.empty(0, U)
        self.doc = np.repeat(np.arange(len(text)), np.diff(self.off))

    def starts(self, n: int) -> np.ndarray:
        """Where a window of ``n`` words of one text starts (mask)."""
        if len(self.doc) < n:
            return np.zeros(0, bool)
        return self.doc[: len(self.doc) - n + 1] == self.doc[n - 1:]

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of every ``n`` consecutive words."""
        other = mix(self.hash, np.full(len(self.hash), 0x5851F42D4C957F2D, U))
        return grams(self.hash, n), grams(other, n)


def as_ids(cell) -> np.ndarray:
    """Ids as numbers; null goes before all others."""
    return np.array([np.iinfo(np.int64).min if x is None else x for x in cell], np.int64)


def sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` (idempotent) over every ``n`` consecutive entries, by doubling."""
    if len(x) < n:
        return x[:0]
    size, out = len(x) - n + 1, x
    width = 1
    while width * 2 <= n:
        out = op(out[:-width], out[width:])
        width *= 2
    return op(out[:size], out[n - width: n - width + size])


def minimisers(b: BlockWords, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-selected positions.  For every window of ``window`` words of one
    text, the least hash of a ``gram`` in it (and the mask of windows); and the
    positions that are the least of some window (all of them, on ties).  The
    same words always select the same places, whatever stands around them."""
    g, ok = grams(b.hash, gram), b.starts(window)
    w = window - gram + 1
    least = sliding(g, w, np.minimum)[: len(ok)]
    if not len(ok):
        return least, ok, np.zeros(len(g), bool)
    held = np.concatenate([np.zeros(w - 1, U), np.where(ok, least, U(0)), np.zeros(w - 1, U)])
    most = sliding(held, w, np.maximum)  # over the windows that hold a position
    live = sliding(np.concatenate([np.zeros(w - 1, bool), ok, np.zeros(w - 1, bool)]), w, np.logical_or)
    return least, ok, (most == g) & live


def packed(values: np.ndarray, bucket: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Values by bucket, as bytes."""
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(k, values[edge[k]:edge[k + 1]].tobytes()) for k in range(buckets) if edge[k] < edge[k + 1]]


def repeated_marks(blocks: DataFrame, marks, buckets: int) -> DataFrame:
    """``(block, found array<binary>)``: which of the 64-bit marks of a block
    occur at two places of the corpus at least.

    ``marks(words)`` gives a block's marks, one entry a place.  Each block sends
    a mark once (twice if it has it at two places), so a mark that stands
    everywhere costs one entry a block, and a bucket of marks is a bounded share
    of all.
    """
    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = BlockWords(unpack(batch.column("size")[i].as_py(), batch.column("body")[i].as_py()))
                value, count = np.unique(marks(b), return_counts=True)
                value = np.repeat(value, np.minimum(count, 2))
                rows = packed(value, (value >> U(20)) % U(buckets), buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()),
                     pa.array([x for _, x in rows], pa.binary())], ["bucket", "block", "marks"])

    def meet(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, U) for x in table.column("marks").to_pylist()]
        value, count = np.unique(np.concatenate(blobs), return_counts=True)
        value = value[count > 1]
        found = []
        for x in blobs:
            x = np.unique(x)
            at = np.searchsorted(value, x)
            hit = x[(at < len(value)) & (value[np.minimum(at, len(value) - 1)] == x)] if len(value) else x[:0]
            found.append(hit.tobytes())
        keep = [i for i, x in enumerate(found) if x]
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())), "found": pa.array([found[i] for i in keep], pa.binary())})

    sent = blocks.select("block", "size", "body").mapInArrow(send, "bucket int, block long, marks binary")
    back = sent.groupBy("bucket").applyInArrow(meet, "block long, found binary")
    return back.groupBy("block").agg(F.collect_list("found").alias("found"))


def marks_of(cell) -> np.ndarray:
    """Sorted marks of an ``array<binary>`` cell (None: none)."""
    return np.sort(np.concatenate([np.frombuffer(x, U) for x in cell])) if cell else np.empty(0, U)


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Mask of ``x`` in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def group_count(total: int, spark, capacity: int) -> int:
    """Groups that hold ``capacity`` entries each at most on average."""
    return max(shuffle_partitions(spark), -(-total // capacity))
