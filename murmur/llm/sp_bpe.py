"""SentencePiece merge-type encoding by backtracking, and decoding.

A merge-type encoding is the only sequence of pieces that spells the text and
in which every two neighbours are compatible: merging their joined text anew
gives exactly those two pieces.  So the encoder walks left to right, always
tries the longest piece that starts here (found by one Aho-Corasick pass over
the text), falls back to shorter ones, and remembers in a bitfield the
positions from which no compatible end was reached.  It is linear in practice
and needs no priority queue.

Texts are cut before encoding at places where no piece of the vocabulary holds
the two characters on either side (before the space mark, for this family of
vocabularies): no merge crosses them.  The parts repeat a lot, so each worker
remembers the parts it has encoded.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from murmur.llm.common import map_slices, on_workers, texts, with_id
from murmur.llm.wordtable import Remembered, in_worker, ragged

MARK = "\u2581"


class Vocabulary:
    """Pieces of a merge-type model and the encoder over them."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.score = {}, [sp.unk_id()] * 256, {}
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i):
                self.text.append(b"")
            elif sp.is_unknown(i):
                self.text.append(" \u2047 ".encode())
            else:
                self.text.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.pieces[piece] = i
                    self.score[piece] = sp.get_score(i)
        self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        self.cut_at_mark = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        # pieces that merging really makes: each must be the merge of its own text
        self.whole = {p for p in self.pieces if len(p) == 1 or self.merge(p) == [p]}
        self.find = ahocorasick.Automaton()
        for p in self.whole:
            self.find.add_word(p, p)
        self.find.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None)
                        for p in self.whole}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Merge by score, leftmost first: the definition, for short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def encode_part(self, part: str) -> list[str]:
        """Pieces of a text without a further cut, by backtracking."""
        n = len(part)
        longest = list(part)  # a character that the vocabulary lacks stands alone
        for end, piece in self.find.iter(part):
            begin = end - len(piece) + 1
            if len(longest[begin]) < len(piece):
                longest[begin] = piece
        failed = bytearray(n + 1)  # positions with no compatible end beyond them
        out: list[str] = []
        at, piece = 0, longest[0] if n else None
        while at < n:
            while piece is not None:
                if not failed[at + len(piece)] and (not out or self.compatible(out[-1], piece)):
                    break
                piece = self.shorter.get(piece)
            if piece is None:  # no way on from here: shorten the piece before
                failed[at] = 1
                last = out.pop()
                at -= len(last)
                piece = self.shorter.get(last)
            else:
                out.append(piece)
                at += len(piece)
                piece = longest[at] if at < n else None
        return out

    def ids(self, part: str) -> np.ndarray:
        out: list[int] = []
        for p in self.encode_part(part):
            i = self.pieces.get(p)
            out.extend([i] if i is not None else [self.bytes[b] for b in p.encode()])
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; one leading space (the one put before a text) goes."""
        raw = b"".join([self.text[i] for i in ids.tolist()])
        if len(ids) and raw[:1] == b" " and not self.is_byte[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    return in_worker(("sp", path), lambda: Vocabulary(path))


def cut(text: pa.Array, voc: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """Parts that no merge crosses, and their offsets by text.  A cut stands
    before a space mark that follows another character."""
    marked = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(MARK, pc.replace_substring(text, " ", MARK), ""))
    if not voc.cut_at_mark:
        return marked, np.arange(len(text) + 1, dtype=np.int64)
    lists = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", "\\1\x00\\2"), "\x00")
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), off - off[0]


def encode_batch(text: pa.Array, voc: Vocabulary, table: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the offsets of each text's ids."""
    nul = pc.match_substring(text, "\x00").to_numpy(zero_copy_only=False)
    if nul.any():  # the cut mark itself occurs: such texts are not cut
        each = [voc.ids(MARK + t.replace(" ", MARK)) if z and t else None for t, z in zip(text.to_pylist(), nul, strict=True)]
        ids, off = encode_batch(pc.if_else(pa.array(nul), "", text), voc, table)
        parts = [e if e is not None else ids[off[i]:off[i + 1]] for i, e in enumerate(each)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    parts, off = cut(text, voc)
    coded = parts.dictionary_encode()
    made = table.get(coded.dictionary.to_pylist())
    lengths = np.array([len(x) for x in made], np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = coded.indices.to_numpy(zero_copy_only=False)
    flat = np.concatenate(made) if made else np.empty(0, np.int32)
    total = np.concatenate([[0], np.cumsum(lengths[codes])])
    return ragged(codes, starts, lengths, flat), total[off]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>, decoded)`` of every row of ``docs``.

    Null text is empty text: no ids, decoded to the empty string.  Texts of any
    length are encoded whole.  Repeated rows give repeated rows, further columns
    are ignored, an empty table gives an empty result.
    """
    def task():
        voc = vocabulary(path)
        table = in_worker(("sp-parts", path), lambda: Remembered(lambda xs: [voc.ids(x) for x in xs]))

        def part(batch):
            ids, off = encode_batch(texts(batch, text), voc, table)
            decoded = [voc.decode(ids[a:b]) for a, b in zip(off, off[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), lists, pa.array(decoded, pa.string())],
                                              ["doc_id", "n_tokens", "ids", "decoded"])
        return part

    return _over(docs, text, "n_tokens long, ids array<int>, decoded string", task)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of ids and text, taken
    in the worker so that neither leaves it."""
    def task():
        voc = vocabulary(path)
        table = in_worker(("sp-parts", path), lambda: Remembered(lambda xs: [voc.ids(x) for x in xs]))
        names = in_worker(("sp-names", path), lambda: [str(i).encode() for i in range(len(voc.text))])

        def part(batch):
            ids, off = encode_batch(texts(batch, text), voc, table)
            n, a, b = np.diff(off), [], []
            for lo, hi in zip(off, off[1:], strict=False):
                own = ids[lo:hi]
                a.append(hashlib.sha256(b",".join([names[i] for i in own.tolist()])).hexdigest())
                b.append(hashlib.sha256(voc.decode(own).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                              ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return part

    return _over(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", task)


def _over(docs: DataFrame, text: str, columns: str, task) -> DataFrame:
    on_workers(docs.sparkSession)
    docs = docs.select("doc_id", docs[text].cast("string").alias(text))
    return map_slices(docs, text, with_id(docs, columns), task)
