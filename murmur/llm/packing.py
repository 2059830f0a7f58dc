"""Packing along a space-filling curve.

Each document becomes a hashed bag-of-words vector, is projected to a few
dimensions with a fixed random matrix and gets the Hilbert key of its cell.
Only ``(key, id, length)`` is range-sorted; running totals over that order
place every document on one long line of tokens along the curve, which is cut
every ``length`` tokens.  So a sequence holds documents that are neighbours on
the curve, all sequences but the last are full, and no task sees more than its
share.
"""

from __future__ import annotations

import os
import zlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import hash64, map_slices, on_workers, texts, words, written
from murmur.llm.wordtable import Remembered, in_worker, ragged

#: Hashed vector width, projected dimensions, bits of the grid in each.
BUCKETS, DIMS, BITS = 256, 4, 12


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of integer points (n x d, ``bits`` bits a coordinate)."""
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(d):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        t ^= np.where((x[d - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def projection(seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def curve_keys(codes: np.ndarray, hashes: np.ndarray, off: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as coded words.  A document without
    words lies in the middle of the grid."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    h = hashes[codes]
    sign = np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), sign, n * BUCKETS).reshape(n, BUCKETS)
    v = np.sign(v) * np.log1p(np.abs(v))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    edges = np.array([NormalDist().inv_cdf(i / 4096) for i in range(1, 4096)], np.float32)  # even fill of the grid
    cell = np.searchsorted(edges, v.astype(np.float32) @ matrix)
    return hilbert(cell * (1 << BITS) // 4096)


#: Words that the library is given in one string.
JOINED = 2_000
#: ASCII marks but the apostrophe, which pre-tokenisers treat in ways of its own.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def ids_of(path: str):
    """Function from words to their ids (little-endian bytes), once a process.

    Words go to the library many at a time, with one of its special strings
    between them, and the ids are parted at that string's id; this saves the
    library's cost of a call a word.  Words that hold such a string, and all
    words if the vocabulary has none, go one by one.
    """
    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        kind = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
        special = {i: x.content for i, x in t.get_added_tokens_decoder().items() if x.special}
        mark = max(special) if special else None
        one_by_one = getattr(t, "encode_batch_fast", t.encode_batch)
        # may words be lower-cased and trimmed?  Only if the vocabulary lower-cases and parts letters from marks
        probe = lambda w: one_by_one([w], add_special_tokens=False)[0].ids
        trims = probe("Abc") == probe("abc") and all(probe("abc" + m * 2) == probe("abc") + probe(m * 2) for m in _MARKS)

        def single(words_: list[str]) -> list[bytes]:
            return [np.array(e.ids, kind).tobytes() for e in one_by_one(words_, add_special_tokens=False)]

        def together(words_: list[str], call, sign: str, sign_id: int) -> list[bytes]:
            parts = [words_[k:k + JOINED] for k in range(0, len(words_), JOINED)]
            out: list[bytes] = []
            for e in call([f" {sign} ".join(part) for part in parts], add_special_tokens=False):
                ids = np.array(e.ids, kind)
                cut = np.flatnonzero(ids == sign_id)
                raw, width = ids.tobytes(), ids.itemsize
                out.extend(raw[a:b] for a, b in zip([0, *((cut + 1) * width).tolist()], [*(cut * width).tolist(), len(raw)], strict=True))
            return out

        # lower-case Latin words are left as they are by the normaliser and are one
        # pre-token, so the same model without those two steps gives the same ids
        short, short_sign = None, None
        if trims and mark is not None:
            short = Tokenizer(t.model)
            short.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            short.add_special_tokens([special[mark]])
            short_sign = short.token_to_id(special[mark])
            probes = ["abc", "überraß", "élève", "x" * 40]
            if [x.ids for x in short.encode_batch(probes)] != [probe(x) for x in probes]:
                short = None

        def encode(words_: list[str]) -> list[bytes]:
            if mark is None:
                return single(words_)
            kinds = [2 if any(s in w for s in special.values()) else 0 if short is not None and w.isalpha() and max(w) < "\u0250" and w == w.lower() else 1
                     for w in words_]
            out: list = [None] * len(words_)
            for k in set(kinds):
                at = [i for i, x in enumerate(kinds) if x == k]
                own = [words_[i] for i in at]
                made = single(own) if k == 2 else together(own, one_by_one, special[mark], mark) if k else together(own, getattr(short, "encode_batch_fast", short.encode_batch), special[mark], short_sign)
                for i, x in zip(at, made, strict=True):
                    out[i] = x
            return out

        return kind, Remembered(encode), [x.lower() for x in special.values()] if trims else None
    return in_worker(("ids", path), load)


def parted(distinct: pa.Array, trims: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Strings to encode, and for each distinct word the numbers of its letters
    and of the ASCII marks after them.  Letters and such marks are pre-tokens of
    their own, so ``word``, ``word,`` and ``word.`` share the ids of ``word``.
    Other words are one string; the empty string stands for no marks."""
    if not trims:
        return [*distinct.to_pylist(), ""], np.arange(len(distinct)), np.full(len(distinct), len(distinct))
    base = pc.utf8_rtrim(distinct, characters=_MARKS)
    cut = pc.and_(pc.utf8_is_alpha(base), pc.not_equal(base, distinct))
    coded = pc.if_else(cut, base, distinct).dictionary_encode()
    strings, own = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    marks = {"": len(strings)}
    strings.append("")
    tail = np.full(len(distinct), marks[""])
    at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
    whole = distinct.take(pa.array(at)).to_pylist()
    for i, w in zip(at.tolist(), whole, strict=True):
        t = w[len(strings[own[i]]):]
        if t not in marks:
            marks[t] = len(strings)
            strings.append(t)
        tail[i] = marks[t]
    return strings, own, tail


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``(rid, doc_id, key, n, ids binary)``: the ids of each document with the
    end id, its curve key and a row number that is unique in the table.

    The tokenizer must drop white space and never merge across it, as the one
    with word ends does; then the ids of a text are those of its words.
    """
    def task():
        kind, table, special = ids_of(path)
        matrix = projection()
        pid, seen = TaskContext.get().partitionId(), 0
        width, end = np.dtype(kind).itemsize, np.array([end_id], kind).tobytes()

        def part(batch):
            nonlocal seen
            text = texts(batch)
            plain = special is not None and not any(pc.any(pc.match_substring(text, s, ignore_case=True)).as_py() for s in special)
            codes, distinct, off = words(text, lower=plain)
            distinct, own, tail = parted(distinct, special is not None)
            made = table.get(distinct)
            flat = np.frombuffer(b"".join(made), kind)
            lengths = np.array([len(x) // width for x in made], np.int64)
            starts = np.cumsum(lengths) - lengths
            # ids of a word: those of its letters, then those of its marks
            both = np.stack([own, tail], 1).ravel() if len(own) else own
            flat, lengths = ragged(both, starts, lengths, flat), lengths[both].reshape(-1, 2).sum(1)
            starts = np.cumsum(lengths) - lengths
            ids = ragged(codes, starts, lengths, flat)
            cut = np.concatenate([[0], np.cumsum(lengths[codes])])[off]
            keys = curve_keys(codes, hash64(distinct)[own], off, matrix)
            rows = batch.num_rows
            rid = (np.int64(pid) << 36) + seen + np.arange(rows)
            seen += rows
            blobs = [ids[a:b].tobytes() + end for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays(
                [pa.array(rid), batch.column("doc_id"), pa.array(keys), pa.array(np.diff(cut) + 1), pa.array(blobs, pa.binary())],
                ["rid", "doc_id", "key", "n", "ids"])
        return part

    on_workers(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs, "text", f"rid long, doc_id {kind}, key long, n long, ids binary", task, 5 << 20)


def placed(rows: DataFrame) -> DataFrame:
    """``(rid, place)``: the tokens that lie before each document on the curve,
    as running totals in ``(key, doc_id, rid)`` order."""
    def run(batches):
        pid, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            here = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(here), pa.array(n), pa.array(np.full(len(n), pid, np.int32))],
                                             ["rid", "here", "n", "part"])

    ordered = rows.select("key", "doc_id", "rid", "n").repartitionByRange("key", "doc_id", "rid")
    local = written(ordered.sortWithinPartitions("key", "doc_id", "rid").mapInArrow(run, "rid long, here long, n long, part int"), "places")
    # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("off"))
    return local.join(F.broadcast(parts), "part").select("rid", (F.col("here") + F.col("off")).alias("place"))


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset[, ids])`` of all documents, packed into sequences of ``length``.

    Null and empty texts are one end id.  Ties of the curve key go by id and
    then by row, repeated rows are documents of their own, further columns are
    ignored, an empty table gives no pieces.  A document longer than a sequence
    spans several.  ``ids_crc32`` is the checksum of the piece's ids as
    unsigned 32-bit little-endian numbers.
    """
    rows = written(tokenised(docs, path, end_id), "tokens")
    kind = np.dtype("<u2")  # the stored width, known from the lengths of a row
    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        for b in batches:
            place, n = b.column("place").to_numpy(), b.column("n").to_numpy()
            blobs = b.column("ids").to_pylist()
            first = place // length
            pieces = (place + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = np.repeat(first - (np.cumsum(pieces) - pieces), pieces) + np.arange(len(row))
            lo = np.maximum(seq * length, place[row])
            hi = np.minimum((seq + 1) * length, (place + n)[row])
            start = lo - place[row]
            crc, own = np.empty(len(row), np.int64), []
            for i, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), (hi - lo).tolist(), strict=True)):
                width = len(blobs[r]) // int(n[r])
                ids = np.frombuffer(blobs[r], kind if width == 2 else "<u4", m, s * width).astype("<u4")
                crc[i] = zlib.crc32(ids.tobytes())
                if with_ids:
                    own.append(ids.astype(np.int32))
            cols = [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(crc), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols, names = [*cols, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind_id = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.select("rid", "doc_id", "n", "ids").join(placed(rows), "rid").select("doc_id", "n", "ids", "place")
    return joined.mapInArrow(run, f"doc_id {kind_id}, {columns}" + ", ids array<int>" * with_ids)
