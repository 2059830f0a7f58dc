"""Substring dedup with prefix-partitioned suffix trees.

A suffix is the sequence of words from one place of a document on.  Suffixes
are dealt to groups by their first words: one word, or two, four or eight where
a shorter prefix has more suffixes than a group may hold (and by a hash of the
whole edge where even eight do), so a group fits in memory.

A suffix travels as its first ``window`` words in ``EDGES`` symbols, each a hash of
a few words in a row.  In a group the suffixes are sorted by their symbols, the
common prefixes of neighbours are measured, and the inner nodes of the subtree are
read off them: a node is a run of suffixes with a longer common prefix than they
have with the suffixes around.  The suffixes below a node at the full depth
(``window`` words) start with the same words; all but the first of them, in
document order, start a repeat, and overlapping repeats of a document join to
maximal ones.  Nodes deeper than that could change nothing and are not made.

Before suffixes are dealt, those that can't lie below a deep node are left out:
a repeated window has a repeated least gram (minimiser).  Equal suffixes within
one block of documents are dealt once, so the copies of a text, however many,
put at most one entry a block into a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.blocks import BlockWords, as_ids, group_count, marks_of, member, minimisers, repeated_marks, rows_of, unpack, write_blocks
from murmur.llm.common import U, grams, runs, written

#: Prefix lengths in words, bins of their hashes that are counted, and the
#: suffixes that a group holds at most where prefixes allow.
PREFIXES, BINS, CAPACITY = (1, 2, 4, 8), 1 << 12, 1_000_000
GRAM = 6
#: Symbols that a suffix is spelt with, down to the full depth.
EDGES = 4


def edge_words(window: int) -> list[tuple[int, int]]:
    """First word and number of words of each symbol."""
    cut = [k * window // EDGES for k in range(EDGES + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def symbols(b: BlockWords, places: np.ndarray, window: int) -> np.ndarray:
    """The symbols of the suffixes at ``places``, a row each (64 bits a symbol)."""
    out, made = np.empty((len(places), EDGES), U), {}
    for k, (first, n) in enumerate(edge_words(window)):
        if n not in made:
            made[n] = grams(b.hash, n)
        out[:, k] = made[n][places + first]
    return out


def inner_nodes(common: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and last row of the inner nodes of a sorted group, down from
    depth ``least``.  ``common[i]`` is what row ``i`` shares with row ``i + 1``;
    rows that share ``d`` symbols throughout are one node if no more is shared by all."""
    depth, first, last = [], [], []
    for d in range(least, EDGES + 1):
        deep = np.concatenate([[False], common >= d, [False]])
        lo, hi = np.flatnonzero(~deep[:-1] & deep[1:]), np.flatnonzero(deep[:-1] & ~deep[1:])
        here = np.concatenate([[0], np.cumsum(common == d)])
        own = here[hi] > here[lo]
        depth.append(np.full(int(own.sum()), d))
        first.append(lo[own])
        last.append(hi[own])
    return np.concatenate(depth), np.concatenate(first), np.concatenate(last)


def prefix_bins(b: BlockWords, window: int) -> np.ndarray:
    """Bin of each prefix length, for every place."""
    n = max(0, len(b.hash) - window + 1)
    return np.stack([(grams(b.hash, k)[:n] >> U(13)).astype(np.int64) % BINS for k in PREFIXES]) if n else np.zeros((len(PREFIXES), 0), np.int64)


def prefix_counts(window: int):
    """Counts of prefixes by length and bin, of all suffixes of a block that
    are long enough to reach the depth."""
    def count(b: BlockWords) -> bytes:
        ok = b.starts(window)
        return np.concatenate([np.bincount(x[ok], minlength=BINS) for x in prefix_bins(b, window)]).astype("<u4").tobytes()
    return count


class Prefixes:
    """The dealing: which prefix length a suffix goes by, and its group."""

    def __init__(self, counts: np.ndarray, groups: int):
        self.fits = counts <= max(1, int(counts[0].sum()) // groups)
        size = np.where(self.fits, counts, 0).ravel()
        total = np.cumsum(size) - size
        share = max(1, int(counts[0].sum()) // groups)
        self.group = (total // share).reshape(counts.shape)
        self.groups = int(self.group.max()) + 1
        self.rest = groups  # for suffixes no prefix of which fits

    def of(self, bins: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = self.groups + (key % U(self.rest)).astype(np.int64)
        for k in range(len(PREFIXES) - 1, -1, -1):
            fits = self.fits[k][bins[k]]
            out = np.where(fits, self.group[k][bins[k]], out)
        return out


def prefixes(blocks: DataFrame, capacity: int = CAPACITY) -> tuple[Prefixes, int]:
    """Sum the counts over all blocks; the driver gets one row a bin."""
    def total(batches):
        all_ = np.zeros(len(PREFIXES) * BINS, np.int64)
        for b in batches:
            for x in b.column("extra").to_pylist():
                all_ += np.frombuffer(x, "<u4")
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(all_[at])], ["bin", "n"])

    counts = np.zeros(len(PREFIXES) * BINS, np.int64)
    for r in blocks.select("extra").mapInArrow(total, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    counts = counts.reshape(len(PREFIXES), BINS)
    n = int(counts[0].sum())
    return Prefixes(counts, group_count(n, blocks.sparkSession, capacity)), n


def candidates(b: BlockWords, found: np.ndarray, window: int) -> np.ndarray:
    """Places whose window has a repeated least gram."""
    least, ok, _ = minimisers(b, window, GRAM)
    distinct, at = np.unique(least, return_inverse=True)
    return np.flatnonzero(ok & member(distinct, found)[at]) if len(ok) else np.empty(0, np.int64)


def firsts(b: BlockWords, ids: np.ndarray, places: np.ndarray, window: int):
    """The places, the keys of their windows, and for each the index of the
    first place of this block, in document order, with an equal window."""
    one, two = b.keys(window)
    one, two = one[places], two[places]
    order = np.lexsort((places, ids[b.doc[places]], two, one))
    fresh = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]) if len(order) else np.empty(0, bool)
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(order) else 0
    return one, two, first


def repeats(blocks: DataFrame, marks: DataFrame, deal: Prefixes, window: int) -> DataFrame:
    """``(block, later array<binary>)``: the places (numbers of words in the
    block) whose window also starts earlier, as little-endian 32-bit numbers."""
    sent = blocks.sparkSession.sparkContext.broadcast(deal)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = BlockWords(unpack(batch.column("size")[i].as_py(), batch.column("body")[i].as_py()))
                ids = as_ids(batch.column("doc_id")[i].as_py())
                places = candidates(b, marks_of(batch.column("found")[i].as_py()), window)
                one, _, first = firsts(b, ids, places, window)
                own = first == np.arange(len(places))
                group = sent.value.of(prefix_bins(b, window)[:, places[own]], one[own])
                order = np.argsort(group, kind="stable")
                at = runs(group[order])
                leaf = [np.split(x[own][order], at[1:]) for x in (symbols(b, places, window), ids[b.doc[places]], places.astype("<i4"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[order][at]), pa.array(np.full(len(at), batch.column("block")[i].as_py(), np.int64)),
                     *(pa.array([x.tobytes() for x in col][: len(at)], pa.binary()) for col in leaf)],
                    ["bucket", "block", "symbols", "ids", "places"])

    def subtree(table: pa.Table) -> pa.Table:
        """The subtree of a group; below each node of the full depth all
        suffixes but the first repeat."""
        get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        size = [len(x) for x in get("places", "<i4")]
        spelt = np.concatenate(get("symbols", U)).reshape(-1, EDGES)
        ids, places = (np.concatenate(get(c, t)) for c, t in (("ids", "<i8"), ("places", "<i4")))
        block = np.repeat(table.column("block").to_numpy(), size)
        order = np.lexsort((places, block, ids, *spelt.T[::-1]))  # by symbols, then in document order
        spelt = spelt[order]
        same = spelt[1:] == spelt[:-1]
        common = np.where(same.all(axis=1), EDGES, same.argmin(axis=1))
        _, first, last = inner_nodes(common, EDGES)
        start = np.zeros(len(order) + 1, np.int64)
        np.add.at(start, first + 1, 1)  # the first suffix below a node is no repeat
        np.add.at(start, last + 1, -1)
        later = np.zeros(len(order), bool)
        later[order] = np.cumsum(start)[:-1] > 0
        edge = np.concatenate([[0], np.cumsum(size)])
        out = [places[a:b][later[a:b]].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
        keep = [i for i, x in enumerate(out) if x]
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())), "later": pa.array([out[i] for i in keep], pa.binary())})

    kind = "bucket long, block long, symbols binary, ids binary, places binary"
    # both sides are partitioned by block as the table is: only the marks move
    leaves = blocks.select("block", "doc_id", "size", "body").join(marks, "block").mapInArrow(send, kind)
    back = leaves.groupBy("bucket").applyInArrow(subtree, "block long, later binary")
    return back.groupBy("block").agg(F.collect_list("later").alias("later"))


def found(docs: DataFrame, window: int, capacity: int, carry: bool) -> DataFrame:
    """Blocks of the documents with the marks and repeats of each."""
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words at least")
    blocks = write_blocks(docs, prefix_counts(window), carry=carry)
    deal, n = prefixes(blocks, capacity)
    least = lambda b: grams(b.hash, GRAM)[minimisers(b, window, GRAM)[2]]
    marks = written(repeated_marks(blocks, least, group_count(n // 4, blocks.sparkSession, capacity)), "marks")
    later = written(repeats(blocks, marks, deal, window), "repeats")
    return blocks.drop("extra").join(marks, "block", "left").join(later, "block", "left")


def gone_words(batch: pa.RecordBatch, i: int, window: int) -> tuple[BlockWords, np.ndarray]:
    """The words of a block and the mask of those that are removed."""
    b = BlockWords(unpack(batch.column("size")[i].as_py(), batch.column("body")[i].as_py()))
    gone = np.zeros(len(b.codes) + 1, np.int64)
    marked = batch.column("found")[i].as_py()
    if marked:
        places = candidates(b, marks_of(marked), window)
        _, _, first = firsts(b, as_ids(batch.column("doc_id")[i].as_py()), places, window)
        late = np.zeros(len(b.codes) + 1, bool)
        for x in batch.column("later")[i].as_py() or ():
            late[np.frombuffer(x, "<i4")] = True
        late[places[first != np.arange(len(places))]] = True  # an equal window of this block comes first
        at = np.flatnonzero(late)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
    return b, np.cumsum(gone)[:-1] > 0


def dedup(docs: DataFrame, window: int = 20, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, spans)`` of every row: words that
    lie in a window of ``window`` words that also starts earlier (smaller id, or
    further up in the same document) are removed; ``kept`` is the rest, joined
    by one space, ``spans`` the removed ``(start, length)`` runs of words.

    Null and empty texts have no words.  A null id goes before all others.  Rows
    with equal ids are taken in the order in which they lie in the input (equal
    rows give the same results either way).  Further columns are ignored, an
    empty table gives an empty result, texts of any length are taken whole.
    Windows are judged on the input, not on what is left.  ``window`` is at
    least GRAM.
    """
    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,length:long>>"

    def apply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield removed(*gone_words(batch, i, window), batch.column("doc_id")[i].as_py())

    return found(docs, window, capacity, False).mapInArrow(apply, schema)


def without_repeats(docs: DataFrame, window: int = 20, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with repeats taken out as by :func:`dedup`; all columns stay.
    The text of a row that loses no word is unchanged; rows that lose all their
    words go; ``n_chars``, if there, is counted anew."""
    order = docs.columns

    def apply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, gone = gone_words(batch, i, window)
                out = removed(b, gone, batch.column("doc_id")[i].as_py())
                text = unpack(batch.column("size")[i].as_py(), batch.column("body")[i].as_py())
                cut, n = (out.column(c).to_numpy() for c in ("n_removed", "n_words"))
                new = pc.if_else(pa.array(cut > 0), out.column("kept"), text)
                rows = rows_of(batch.column("rest")[i].as_py()).append_column("text", new).select(order)
                yield from rows.filter(pa.array((cut < n) | (n == 0))).to_batches()

    clean = found(docs, window, capacity, True).mapInArrow(apply, docs.withColumn("text", F.col("text").cast("string")).schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in order else clean


def removed(b: BlockWords, gone: np.ndarray, ids: list) -> pa.RecordBatch:
    """Rows of a block, given the mask of removed words."""
    n = len(b.off) - 1
    cut = np.bincount(b.doc[gone], minlength=n)
    kept_off = np.concatenate([[0], np.cumsum(np.diff(b.off) - cut)])
    word = np.array(b.distinct.to_pylist(), object)
    kept = word[b.codes[~gone]].tolist() if len(b.codes) else []
    text = [" ".join(kept[lo:hi]) for lo, hi in zip(kept_off, kept_off[1:], strict=False)]
    edge = gone & np.concatenate([[True], ~gone[:-1] | (b.doc[1:] != b.doc[:-1])]) if len(gone) else gone
    begin = np.flatnonzero(edge)
    stop = gone & np.concatenate([~gone[1:] | (b.doc[1:] != b.doc[:-1]), [True]]) if len(gone) else gone
    length = np.flatnonzero(stop) + 1 - begin
    off = np.concatenate([[0], np.cumsum(np.bincount(b.doc[begin], minlength=n))]).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(begin - b.off[b.doc[begin]]), pa.array(length)], ["start", "length"]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(b.off)), pa.array(cut.astype(np.int64)), pa.array(text, pa.string()), spans],
                                      ["doc_id", "n_words", "n_removed", "kept", "spans"])
