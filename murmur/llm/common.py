"""Helpers shared by the training-data operators.

All per-row Python here works on Arrow batches that Spark deals out: a batch
is cut into slices of bounded text size, the words of a slice are found and
numbered once by Arrow, and numpy works on the numbers.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from murmur.session import scratch_path, table

#: Text bytes that one slice holds at most (a longer single text stands alone).
SLICE_BYTES = 6 << 20

U = np.uint64
_K1, _K2, _K3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(on_workers(spark), sf_dir, "documents")


#: Folders that operators of this process made, and the catalog tables over them.
_MADE: dict[str, str | None] = {}


def scratch(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new folder under ``spark.checkpoint.dir`` (and the table that will lie
    there)."""
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")
    _MADE[path] = table
    return path


def release_all_but(docs: DataFrame) -> DataFrame:
    """Drop the folders and tables that earlier steps of a chain left, except
    those that ``docs`` still reads; returns ``docs``.  For steps that are
    written before the next one starts."""
    spark = docs.sparkSession
    read = [unquote(f) for f in docs.inputFiles()]
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path, name in list(_MADE.items()):
        if any(f"{path.split(':', 1)[-1].rstrip('/')}/" in f for f in read):
            continue
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = hadoop.Path(path)
        where.getFileSystem(conf).delete(where, True)
        del _MADE[path]
    return docs


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage;
    a lost executor costs a re-read, not a recomputation)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_id(docs: DataFrame, columns: str) -> T.StructType:
    """Schema of an operator's rows: ``doc_id`` as it came, then ``columns``."""
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(columns).fields])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of text."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_slices(df: DataFrame, text: str, schema: str | T.StructType, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
               limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over text-bounded slices; ``fn`` is called once a task
    and returns the function of a slice (a batch, or an iterable of them)."""

    def run(batches):
        part = fn()
        for batch in batches:
            for piece in slices(batch, text, limit):
                out = part(piece)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
            pa.default_memory_pool().release_unused()  # a worker lives on; what it freed need not stay with it

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as plain strings; null becomes empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: codes of all words in
    order, the distinct words that the codes number, and offsets by text."""
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(distinct, "").as_py()
    if blank >= 0:
        keep = codes != blank
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        codes = codes[keep]
    return codes, distinct, off


def hash64(values: pa.Array | list[str]) -> np.ndarray:
    """64-bit hash of each string."""
    values = values if isinstance(values, list) else values.to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), U, len(values))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit mix of two hash arrays."""
    with np.errstate(over="ignore"):
        x = a * _K1 + b * _K2 + _K3
        x ^= x >> U(29)
        x *= _K3
        x ^= x >> U(32)
    return x


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries (``len(h) - n + 1`` of them),
    by doubling: about log2(n) passes instead of n."""
    if len(h) < n:
        return np.empty(0, U)
    out, done, block, width = None, 0, h, 1
    while n:
        if n & 1:
            out = block if out is None else mix(out[: len(h) - done - width + 1], block[done:])
            done += width
        n >>= 1
        if n:
            block = mix(block[:-width], block[width:]) if len(block) > width else block[:0]
            width *= 2
    return out[: len(h) - done + 1]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal entries."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
