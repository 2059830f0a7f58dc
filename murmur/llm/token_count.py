"""Token counts by a map-side two-tier lookup.

The unit that is looked up is the *spaced pre-token*: what stands between two
single spaces, with the space before it.  A byte-level BPE tokenizer never
merges across such a space, so a spaced pre-token is a whole number of the
tokenizer's own pre-tokens and its length in tokens does not depend on its
surroundings.  Texts where that does not hold (two spaces in a row, special
strings of the vocabulary) are encoded whole by the library.

Tier 1 is a compact table of the most frequent spaced pre-tokens with their
lengths, taken from a bounded sample of documents and broadcast; tier 2 is a
bounded cache in each worker that asks the library about misses.  The tables
only save time: results are the library's at every size.  Nothing is shuffled.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import map_slices, on_workers, texts, with_id
from murmur.llm.wordtable import Remembered, in_worker

#: Documents looked at for tier 1, and its entries: together its size bound
#: (an entry is at most ``FREQUENT_CHARS`` characters and one length byte).
SAMPLE_DOCS, FREQUENT, FREQUENT_CHARS = 2_000, 50_000, 32


def library(path: str):
    """The tokenizer of a file, once a process: its count function and the
    strings that it takes as special."""
    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return (lambda xs: [len(x) for x in sp.encode(list(xs), num_threads=1)]), None
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        encode = getattr(t, "encode_batch_fast", t.encode_batch)
        return (lambda xs: [len(x.ids) for x in encode(list(xs), add_special_tokens=False)]), special
    return in_worker(("count", path), load)


def spaced(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces between single spaces, and the offsets of each text's pieces."""
    lists = pc.split_pattern(text, " ")
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), off - off[0]


def whole(text: pa.Array, special: list[str] | None) -> np.ndarray:
    """Texts that only the library may cut."""
    if special is None:  # no spaced pre-tokens known for this kind of model
        return np.ones(len(text), bool)
    out = pc.match_substring(text, "  ")
    for s in special:
        out = pc.or_(out, pc.match_substring(text, s))
    return out.to_numpy(zero_copy_only=False)


def frequent_table(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = FREQUENT) -> bytes:
    """Tier 1 as compressed bytes: the most frequent spaced pre-tokens of at
    most ``sample_docs`` documents (lowest hash of the text) and their lengths.
    Counting is done by Spark; the driver receives ``entries`` rows at most."""
    some = docs.where(F.col("text").isNotNull()).select("text")
    share = F.xxhash64("text", F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    some = some.where(share < sample_docs / max(1, docs.count())).limit(2 * sample_docs)
    piece = F.explode(F.split("text", " ")).alias("piece")
    top = (some.select(piece).where((F.length("piece") > 0) & (F.length("piece") < FREQUENT_CHARS))
           .groupBy("piece").count().orderBy(F.desc("count"), "piece").limit(entries))
    pieces = [" " + r.piece for r in top.collect() if "\x00" not in r.piece]  # that sign parts the entries
    lengths = library(path)[0](pieces) if pieces else []
    return zlib.compress("\x00".join(pieces).encode() + b"\x00\x00" + bytes(min(n, 255) for n in lengths))


def unpacked(blob: bytes) -> dict[str, int]:
    """Tier 1 as a dictionary; a length of 255 stands for "ask the library"."""
    text, _, lengths = zlib.decompress(blob).partition(b"\x00\x00")
    return {p: n for p, n in zip(text.decode().split("\x00"), lengths, strict=False) if n < 255}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    Null text counts as empty (0 bytes, 0 tokens).  Repeated rows give repeated
    rows; columns other than ``doc_id`` and ``text`` are ignored; an empty table
    gives an empty result; very long texts are counted whole.
    """
    spark = on_workers(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(frequent_table(docs, path, sample_docs))

    def task():
        count, special = library(path)
        table = in_worker(("count-tables", path, zlib.crc32(sent.value)), lambda: Remembered(count, unpacked(sent.value)))

        def part(batch):
            text = texts(batch)
            n = np.zeros(len(text), np.int64)
            odd = whole(text, special)
            if odd.any():
                n[odd] = count(text.filter(pa.array(odd)).to_pylist())
            if not odd.all():
                pieces, off = spaced(text.filter(pa.array(~odd)))
                coded = pieces.dictionary_encode()
                lengths = np.array(table.get([" " + s for s in coded.dictionary.to_pylist()]), np.int64)
                each = lengths[coded.indices.to_numpy(zero_copy_only=False)]
                first = off[:-1]  # the first piece has no space before it
                each[first] = table.get(pieces.take(pa.array(first)).to_pylist())
                n[~odd] = np.add.reduceat(each, first)
            size = pc.binary_length(text).cast(pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        return part

    return map_slices(docs, "text", with_id(docs, "n_bytes long, n_tokens long, over_limit boolean"), task)
