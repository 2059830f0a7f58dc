"""Exact Jaccard join of documents by their word shingles, with an R-tree over
count vectors.

A document's set holds the hashes of its shingles.  Hashing them into
``GROUPS`` groups gives a point: how many fall into each.  Two sets share at
most the sum over groups of the lesser count, and two boxes of points at most
that sum over their upper corners, so an R-tree over points rules out most
pairs; those left are verified on the sets.

Pairs that can link share one of the first few shingles of both sets in any
common order (prefix filter), so a tree is built for the documents at each such
shingle.  In that order shingles that many documents hold come last, which
keeps frequent lines and passages out of the prefixes.  Large groups of near
copies are not compared pair by pair:

1. documents of a block link among themselves, and one of each local group goes
   to its few shingles of least hash, where a spanning forest of the surviving
   pairs, those that may be most alike first, is verified; components follow;
2. every prefix shingle learns which components hold it, at which set sizes (one
   entry a block, component and size) and how far down their sets; where none
   meets another component at a size within reach, it is done;
3. at the others, pairs of documents of different components that survive the
   tree and finer counts are verified, so no link is lost.  The finer counts
   are nearly exact for sets of common size, so hardly a pair leaves its task
   that does not link.

Unrelated documents share a shingle by chance, the more so the larger the corpus.
Before counts travel (in 1 and 3), documents therefore meet with the parities of
their shingles' groups, a few bytes each; where those rule out every partner, no
counts are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.blocks import BlockWords, by_block, marks_of, member, packed, rows_of, unpack, write_blocks
from murmur.llm.common import U, grams, mix, runs, shuffle_partitions, written
from murmur.llm.components import components

#: Groups of the count vectors that make the tree's points and boxes; points in
#: a leaf, children of a node.
COARSE, LEAF, FANOUT = 64, 32, 8
#: Groups of the finer counts that a pair meets after the tree: those of sets up
#: to SPARSE shingles are kept as the sorted groups of the shingles, others as a
#: vector of counts.
FINE, GROUPS, SPARSE = 1 << 16, 512, 512
#: Pairs whose counts are compared at a time, and documents whose finer counts
#: are (in one matrix of at most DENSE times DENSE * SPARSE / 2 cells).
STEP, DENSE = 20_000, 192
#: Shingles of least hash that the first round looks at.
FIRST = 3
#: Parities of a set, in tenths of the shingles by which it may differ from one
#: that it links with (half of those of unrelated sets differ); documents at one
#: shingle whose parities are compared pair by pair (larger crowds all go on), and
#: words of parities at a time.
PARITY, CROWD, WORDS = 46, 512, 1 << 20
#: A shingle counts as frequent from this share of documents on.  As there are
#: no more shingles than places for them, at most (mean set size) / SHARE
#: shingles are frequent, however large the corpus; they are broadcast.
SHARE = 0.002


class Sets:
    """Shingle sets of the texts of a block: sorted hashes, offsets, set ids."""

    def __init__(self, b: BlockWords, shingle: int, frequent: np.ndarray | None = None):
        g = grams(b.hash, shingle)
        sets = []
        for lo, hi in zip(b.off.tolist(), b.off[1:].tolist(), strict=False):
            if hi - lo >= shingle:
                sets.append(np.unique(g[lo:hi - shingle + 1]))
            elif hi > lo:  # the whole sequence is the one shingle
                sets.append(np.array([xxhash.xxh3_64_intdigest(b.hash[lo:hi].tobytes(), seed=hi - lo)], U))
            else:
                sets.append(g[:0])
        self.size = np.array([len(x) for x in sets], np.int64)
        self.value = np.concatenate(sets) if sets else g[:0]
        self.doc = np.repeat(np.arange(len(sets)), self.size)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.id = np.array([xxhash.xxh3_64_intdigest(self.value[a:b_].tobytes(), seed=1) >> 1 for a, b_ in zip(self.off, self.off[1:], strict=False)], np.int64)
        self.frequent = frequent

    def row(self, i: int) -> np.ndarray:
        return self.value[self.off[i]:self.off[i + 1]]

    def vectors(self) -> np.ndarray:
        group = (self.value >> U(40)).astype(np.int64) % COARSE
        return np.bincount(self.doc * COARSE + group, minlength=len(self.size) * COARSE).reshape(-1, COARSE).astype(np.int32)

    def details(self) -> list[bytes]:
        """The finer counts of each set."""
        group = ((self.value >> U(20)) % U(FINE)).astype("<u2")
        out = []
        for lo, hi in zip(self.off.tolist(), self.off[1:].tolist(), strict=False):
            own = group[lo:hi]
            out.append(np.sort(own).tobytes() if hi - lo <= SPARSE else shrunk(np.bincount(own % GROUPS, minlength=GROUPS)))
        return out

    def parities(self, percent: int) -> np.ndarray:
        """Of each set, one after the other: whether an odd number of its
        shingles falls into each of its groups."""
        width = parity_words(self.size, percent)
        group = ((self.value >> U(20)) % U(FINE)).astype(np.int64) % (64 * width[self.doc])
        at = 64 * (np.cumsum(width) - width)[self.doc] + group
        odd = (np.bincount(at, minlength=64 * int(width.sum())) % 2).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view("<u8")

    def lowest(self, use: np.ndarray, most: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
        """Document and shingle of the few of least hash, of the documents
        ``use``.  (Those are a fair sample of a set, frequent shingles included:
        near copies share them even where a whole crowd of copies makes all
        their common shingles frequent.)"""
        n = np.minimum(self.size[use], most)
        doc = np.repeat(use, n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        return doc, self.value[self.off[doc] + at]

    def prefixes(self, use: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and shingle of the prefixes of the documents ``use``."""
        last = np.zeros(len(self.value), np.int64)
        if self.frequent is not None and len(self.frequent):
            last += self.frequent[np.minimum(np.searchsorted(self.frequent, self.value), len(self.frequent) - 1)] == self.value
        order = np.argsort(2 * self.doc + last, kind="stable")
        length = np.where(self.size > 0, self.size - -(-percent * self.size // 100) + 1, 0)
        mask = np.zeros(len(self.size), bool)
        mask[use] = True
        keep = (np.arange(len(order)) - self.off[self.doc] < length[self.doc]) & mask[self.doc]
        return self.doc[keep], self.value[order][keep]


def shrunk(vec: np.ndarray) -> bytes:
    """Counts as bytes of the least width that holds them all."""
    most = int(vec.max(initial=0))
    return vec.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u4").tobytes()


def grown(raw: bytes, rows: int, groups: int) -> np.ndarray:
    width = len(raw) // max(1, rows * groups)
    return np.frombuffer(raw, {0: "<u1", 1: "<u1", 2: "<u2", 4: "<u4"}[width]).reshape(rows, groups).astype(np.int32)


def parity_words(size: np.ndarray, percent: int) -> np.ndarray:
    """Words of parities of sets of these sizes: powers of two, so that the
    parities of a larger set fold to those of a smaller one."""
    bits = 64 << np.arange((FINE // 64).bit_length() - 1)
    return np.int64(1) << np.searchsorted((bits - 32) * 10 * (100 + percent) // (PARITY * max(1, 100 - percent)), size)


def pieces(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the runs of these starts and lengths, one after the other."""
    return np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)


def apart(parity: np.ndarray, start: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of shingles that one set of each pair has and the other has
    not: in a group of different parity there is one at least."""
    def folded(x: np.ndarray, w: int) -> np.ndarray:
        out = np.empty((len(x), w), U)
        for v in np.unique(width[x]).tolist():
            at = np.flatnonzero(width[x] == v)
            out[at] = np.bitwise_xor.reduce(parity[start[x[at], None] + np.arange(v)].reshape(len(at), v // w, w), axis=1)
        return out

    least = np.minimum(width[a], width[b])
    found = np.zeros(len(a), np.int64)
    for w in np.unique(least).tolist():
        part = np.flatnonzero(least == w)
        for k in range(0, len(part), max(1, WORDS // w)):
            at = part[k:k + max(1, WORDS // w)]
            found[at] = np.bitwise_count(folded(a[at], w) ^ folded(b[at], w)).sum(1, dtype=np.int64)
    return found


def overlap(x: bytes, n: int, y: bytes, m: int) -> int:
    """Most shingles that two sets of ``n`` and ``m`` can share, by their finer
    counts: the summed minima over the groups."""
    if n <= SPARSE and m <= SPARSE:
        p, q = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
        both = np.sort(np.concatenate([unlike(p), unlike(q)]))
        return int((both[1:] == both[:-1]).sum())
    return int(np.minimum(counts(x, n), counts(y, m)).sum())


def overlaps(detail: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`overlap` of pairs of sets up to SPARSE shingles, side by side: the
    groups that two of their documents hold at least are columns of a matrix."""
    docs, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows = [unlike(np.frombuffer(detail[i], "<u2")) for i in docs.tolist()]
    value, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    number = np.cumsum(count > 1) - 1
    own = np.repeat(np.arange(len(docs)), [len(r) for r in rows])[keep]
    matrix = np.zeros((len(docs), int((count > 1).sum())), np.float32)
    matrix[own, number[column[keep]]] = 1
    return (matrix @ matrix.T)[at[:len(a)], at[len(a):]].astype(np.int64)


def unlike(groups: np.ndarray) -> np.ndarray:
    """Sorted groups as distinct numbers: the k-th of a group differs from its others."""
    start = np.maximum.accumulate(np.where(np.concatenate([[True], groups[1:] != groups[:-1]]), np.arange(len(groups)), 0)) if len(groups) else groups
    return groups.astype(np.int64) * (SPARSE + 1) + np.arange(len(groups)) - start


def counts(raw: bytes, n: int) -> np.ndarray:
    if n <= SPARSE:
        return np.bincount(np.frombuffer(raw, "<u2") % GROUPS, minlength=GROUPS)
    return grown(raw, 1, GROUPS)[0]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    """Union-find over a few nodes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def survives(sa, va, sb, vb, percent: int) -> np.ndarray:
    """Can sets of these sizes and counts overlap enough?  For boxes: least
    sizes, and counts of the upper corners."""
    return (100 + percent) * np.minimum(va, vb).sum(-1, dtype=np.int64) >= percent * (sa + sb)


def near(size: np.ndarray, vec: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Mask of the pairs of points that survive the bound, a step at a time."""
    out = [np.zeros(0, bool)]
    for k in range(0, len(a), STEP):
        x, y = a[k:k + STEP], b[k:k + STEP]
        out.append(survives(size[x], vec[x], size[y], vec[y], percent))
    return np.concatenate(out)


class Tree:
    """R-tree over count vectors, packed bottom up: points are sorted by size
    and, within slabs of like size, by the count that varies most."""

    def __init__(self, size: np.ndarray, vec: np.ndarray):
        n = len(size)
        order = np.argsort(size, kind="stable")
        slab = max(LEAF, int(np.ceil(np.sqrt(n / LEAF))) * LEAF)
        parts = []
        for i in range(0, n, slab):
            part = order[i:i + slab]
            axis = int(np.argmax(vec[part].var(0)))
            parts.append(part[np.argsort(vec[part, axis], kind="stable")])
        self.order = np.concatenate(parts)
        self.size, self.vec = size[self.order], vec[self.order]
        low, high, corner = self.size, self.size, self.vec
        self.levels = []  # from leaves up: least size, greatest size, upper corner of each node
        width = LEAF
        while True:
            at = np.arange(0, len(low), width)
            low, high, corner = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at)
            self.levels.append((low, high, corner))
            if len(low) == 1:
                break
            width = FANOUT

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (i <= j) that may hold a link, from the root down."""
        i = j = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            low, high, corner = self.levels[k]
            if k < len(self.levels) - 1:
                child = np.arange(FANOUT)
                i = (i[:, None] * FANOUT + np.repeat(child, FANOUT)).ravel()
                j = (j[:, None] * FANOUT + np.tile(child, FANOUT)).ravel()
                ok = (i < len(low)) & (j < len(low)) & (i <= j)
                i, j = i[ok], j[ok]
            ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
            i, j = i[ok], j[ok]
            ok = survives(low[i], corner[i], low[j], corner[j], percent)
            i, j = i[ok], j[ok]
        near = np.argsort(j - i, kind="stable")
        return i[near], j[near]

    def pairs(self, percent: int, comp: np.ndarray):
        """Surviving pairs of points of different components, in batches; the
        receiver may unite components (in place) between batches."""
        n = len(self.size)
        left, right = self.leaf_pairs(percent)
        step = np.arange(LEAF)
        for k in range(0, len(left), 64):
            a = (left[k:k + 64, None] * LEAF + np.repeat(step, LEAF)).ravel()
            b = (right[k:k + 64, None] * LEAF + np.tile(step, LEAF)).ravel()
            ok = (a < b) & (b < n)
            a, b = a[ok], b[ok]
            ok = comp[self.order[a]] != comp[self.order[b]]
            a, b = a[ok], b[ok]
            ok = (100 * np.minimum(self.size[a], self.size[b]) >= percent * np.maximum(self.size[a], self.size[b]))
            a, b = a[ok], b[ok]
            ok = near(self.size, self.vec, a, b, percent)
            if ok.any():
                yield self.order[a[ok]], self.order[b[ok]]


def candidate_pairs(token: np.ndarray, node: np.ndarray, size: np.ndarray, vec: np.ndarray, comp: np.ndarray, percent: int, spanning: bool, detail: list[bytes]):
    """Pairs of nodes that share a token, lie in different components and
    survive the bound on ``vec`` and on the finer counts; as arrays.
    ``spanning``: only a forest of them."""
    def closer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = np.empty(len(a), np.int64)
        small = (size[a] <= SPARSE) & (size[b] <= SPARSE)
        for k in range(0, len(a), 2048):
            part = np.arange(k, min(k + 2048, len(a)))
            one = part[small[part]]
            if len(one) > 64 and len(np.unique(np.concatenate([a[one], b[one]]))) <= DENSE:
                shared[one] = overlaps(detail, a[one], b[one])
                part = part[~small[part]]
            for i in part.tolist():
                x, y = a[i], b[i]
                shared[i] = overlap(detail[x], size[x], detail[y], size[y])
        return (100 + percent) * shared >= percent * (size[a] + size[b])

    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
    count = np.diff(edge)
    lefts, rights = [], []
    comp = comp.copy()
    # a few documents are one leaf: all their pairs, once, whatever token they share
    small = [np.empty(0, np.int64)]
    for c in range(2, min(LEAF, int(count.max(initial=0))) + 1):
        at = edge[:-1][count == c]
        if len(at):
            i, j = np.triu_indices(c, 1)
            small.append((node[at[:, None] + i] * len(size) + node[at[:, None] + j]).ravel())
    key = np.unique(np.concatenate(small))
    a, b = key // max(1, len(size)), key % max(1, len(size))
    ok = (comp[a] != comp[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
    a, b = a[ok], b[ok]
    ok = near(size, vec, a, b, percent)
    forest = Forest(len(size)) if spanning else None
    a, b = a[ok], b[ok]
    done = key
    ok = closer(a, b)
    a, b = a[ok], b[ok]
    if spanning and len(a):
        alike = np.argsort(-np.minimum(vec[a], vec[b]).sum(1) / (size[a] + size[b]), kind="stable")
        a, b = a[alike], b[alike]
    take(a, b, forest, comp, lefts, rights)
    seen = set()
    for at, c in zip(edge[:-1][count > LEAF], count[count > LEAF], strict=True):
        own = node[at:at + c]
        name = own.tobytes()  # the copies of a text share many shingles: one tree for all of them
        if hash(name) in seen or (comp[own] == comp[own[0]]).all():
            continue
        seen.add(hash(name))
        part = comp[own]
        for x, y in Tree(size[own], vec[own]).pairs(percent, part):
            # pairs meet at many shingles and are looked at once
            key = np.minimum(own[x], own[y]) * len(size) + np.maximum(own[x], own[y])
            new = ~member(key, done)
            x, y, done = x[new], y[new], np.union1d(done, key[new])
            ok = closer(own[x], own[y])
            take(own[x[ok]], own[y[ok]], forest, comp, lefts, rights)
            if spanning:
                part[:] = comp[own]
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (lefts, rights))
    key = np.unique(np.minimum(a, b) * max(1, len(size)) + np.maximum(a, b))
    return key // max(1, len(size)), key % max(1, len(size))


def take(a, b, forest, comp, lefts, rights) -> None:
    """Keep pairs; with a forest, those that join two of its trees, and number
    the trees anew in ``comp`` (equal numbers: same tree or component).  Pairs
    that may be most alike come first, so that the forest holds few others."""
    if forest is None:
        lefts.append(a)
        rights.append(b)
        return
    keep = []
    for k in range(0, len(a), 4096):
        roots_a, roots_b = comp[a[k:k + 4096]], comp[b[k:k + 4096]]
        for i in np.flatnonzero(roots_a != roots_b):
            if forest.join(int(a[k + i]), int(b[k + i])):
                keep.append(k + int(i))
        touched = np.unique(np.concatenate([a[k:k + 4096], b[k:k + 4096]]))
        comp[touched] = [-1 - forest.root(int(x)) for x in touched]
    lefts.append(a[keep])
    rights.append(b[keep])


def local_groups(s: Sets, nodes: np.ndarray, vec: np.ndarray, detail: list[bytes], percent: int) -> np.ndarray:
    """For each of ``nodes`` (documents of a block with different sets), the
    place in ``nodes`` of its group's first: links are found at the shingles of
    least hash and verified."""
    doc, token = s.lowest(nodes)
    place = np.full(len(s.size), -1)
    place[nodes] = np.arange(len(nodes))
    verified = Forest(len(nodes))
    a, b = candidate_pairs(token, place[doc], s.size[nodes], vec[nodes], np.arange(len(nodes)), percent, True, [detail[i] for i in nodes.tolist()])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if linked(s.row(nodes[x]), s.row(nodes[y]), percent):
            verified.join(x, y)
    return np.array([verified.root(i) for i in range(len(nodes))], np.int64)


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((token >> U(12)) % U(buckets)).astype(np.int64)


def short(token: np.ndarray) -> np.ndarray:
    """Shingles in 32 bits, for a step that may take two of them for one (more
    documents then seem to meet, none fewer)."""
    with np.errstate(over="ignore"):
        return ((token * U(0x9E3779B97F4A7C15)) >> U(32)).astype("<u4")


ENTRY = "bucket int, block long, tokens binary, nodes binary, ids binary, sizes binary, vecs binary, comps binary, details array<binary>"


def entries(block: int, token: np.ndarray, doc: np.ndarray, ids: np.ndarray, size: np.ndarray, vec: np.ndarray, comp: np.ndarray, buckets: int, detail: list[bytes]) -> pa.RecordBatch:
    """Entries by bucket of the shingle; a document's id, size, vector,
    component and finer counts travel once a bucket."""
    rows = packed(np.arange(len(token)), bucket_of(token, buckets), buckets)
    cols: list[list] = [[] for _ in range(6)]
    more = []
    for _, raw in rows:
        at = np.frombuffer(raw, np.int64)
        own, node = np.unique(doc[at], return_inverse=True)
        for col, x in zip(cols, (token[at], node.astype("<i4"), ids[own], size[own], shrunk(vec[own]), comp[own]), strict=True):
            col.append(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())
        more.append([detail[i] for i in own.tolist()])
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols), pa.array(more, pa.list_(pa.binary()))],
                                      ["bucket", "block", "tokens", "nodes", "ids", "sizes", "vecs", "comps", "details"])


def meeting(percent: int, spanning: bool):
    """Function of a bucket of entries: candidate pairs with the blocks that
    hold the two sets."""
    def meet(table: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        ids = get("ids", "<i8")
        base = np.cumsum([0, *map(len, ids)])
        node = np.concatenate([x + o for x, o in zip(get("nodes", "<i4"), base, strict=False)])
        block = np.repeat(table.column("block").to_numpy(), np.diff(base))
        # equal sets of different blocks are one node
        one, first, at = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        token, node = np.concatenate(get("tokens", U)), at[node]
        both = np.unique(np.stack([token.view(np.int64), node], 1), axis=0)
        token, node = both[:, 0].view(U), both[:, 1]
        size = np.concatenate(get("sizes", "<i8"))[first]
        vec = np.concatenate([grown(x, len(n), COARSE) for x, n in zip(table.column("vecs").to_pylist(), ids, strict=True)])[first]
        _, comp = np.unique(np.concatenate(get("comps", "<i8"))[first], return_inverse=True)
        detail = [y for x in table.column("details").to_pylist() for y in x]
        a, b = candidate_pairs(token, node, size, vec, comp, percent, spanning, [detail[i] for i in first.tolist()])
        where = block[first]
        return pa.table({"a": one[a], "b": one[b], "block_a": where[a], "block_b": where[b]})
    return meet


SKETCH = "bucket int, block long, tokens binary, counts binary, docs binary, sizes binary, comps binary, parities binary"


def sketches(block: int, token: np.ndarray, doc: np.ndarray, size: np.ndarray, comp: np.ndarray, parity: np.ndarray, buckets: int, percent: int) -> pa.RecordBatch:
    """Like :func:`entries`, with parities instead of counts and the document's
    place in its block instead of its id; ``doc`` ascends."""
    width = parity_words(size, percent)
    start = np.cumsum(width) - width
    rows = packed(np.arange(len(token)), bucket_of(token, buckets), buckets)
    cols: list[list] = [[] for _ in range(6)]
    for _, raw in rows:
        at = np.frombuffer(raw, np.int64)
        own, count = np.unique(doc[at], return_counts=True)
        for col, x in zip(cols, (short(token[at]).tobytes(), shrunk(count), shrunk(own), shrunk(size[own]), comp[own].tobytes(), parity[pieces(start[own], width[own])].tobytes()), strict=True):
            col.append(x)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)],
                                      [c.split()[0] for c in SKETCH.split(", ")])


def shrunk_lists(cells: list[bytes], like: list) -> np.ndarray:
    """Numbers that :func:`shrunk` wrote, as many a cell as ``like`` has."""
    return np.concatenate([grown(x, len(r), 1).ravel() for x, r in zip(cells, like, strict=True)]).astype(np.int64)


def alike(percent: int):
    """Function of a bucket of sketches: the shingles at which a document meets
    one of another component that it may link with, by size and parities, back
    to its block (one number a shingle and document)."""
    def meet(table: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        tokens, comps = get("tokens", "<u4"), get("comps", "<i8")
        count, doc, size = (shrunk_lists(table.column(c).to_pylist(), comps) for c in ("counts", "docs", "sizes"))
        token, comp, parity = np.concatenate(tokens), np.concatenate(comps), np.concatenate(get("parities", "<u8"))
        node = np.repeat(np.arange(len(comp)), count)
        width = parity_words(size, percent)
        start = np.cumsum(width) - width
        order = np.argsort(token, kind="stable")
        edge = np.append(runs(token[order]), len(token))
        count = np.diff(edge)
        live = np.zeros(len(token), bool)
        for c in np.unique(count[count > 1]).tolist():
            first = edge[:-1][count == c]
            if c > CROWD:
                live[order[(first[:, None] + np.arange(c)).ravel()]] = True
                continue
            i, j = np.triu_indices(c, 1)
            for k in range(0, len(first), max(1, STEP // len(i))):
                at = first[k:k + max(1, STEP // len(i)), None]
                x, y = order[(at + i).ravel()], order[(at + j).ravel()]
                a, b = node[x], node[y]
                ok = (comp[a] != comp[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
                x, y, a, b = x[ok], y[ok], a[ok], b[ok]
                both = size[a] + size[b]
                ok = (100 + percent) * (both - apart(parity, start, width, a, b)) >= 2 * percent * both
                live[x[ok]] = live[y[ok]] = True
        name = mix(token.astype(U), doc[node].astype(U))
        cut = np.cumsum([0, *map(len, tokens)])
        out = [name[a:b][live[a:b]].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        keep = [i for i, x in enumerate(out) if x]
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())), "hot": pa.array([out[i] for i in keep], pa.binary())})
    return meet


PAIR = "a long, b long, block_a long, block_b long"


def verified(blocks: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link.  Only the sets that some pair names are
    made again, each once."""
    pairs = written(pairs.dropDuplicates(["a", "b"]), "pairs")
    need = (pairs.select(F.col("block_a").alias("block"), F.col("a").alias("id")).unionByName(pairs.select(F.col("block_b").alias("block"), F.col("b").alias("id")))
            .groupBy("id").agg(F.min("block").alias("block")).groupBy("block").agg(F.collect_list("id").alias("need")))

    def fetch(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                s = Sets(BlockWords(unpack(batch.column("size")[i].as_py(), batch.column("body")[i].as_py()), True), shingle)
                at = {x: k for k, x in enumerate(s.id.tolist())}
                ids = batch.column("need")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.row(at[x]).tobytes() for x in ids], pa.binary())], ["id", "set"])

    sets = written(blocks.select("block", "size", "body").join(need, "block").mapInArrow(fetch, "id long, set binary"), "sets")

    def check(batches):
        for t in batches:
            ok = [linked(np.frombuffer(p, U), np.frombuffer(q, U), percent) for p, q in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (sets.select(F.col("id").alias(k), F.col("set").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def frequent_shingles(blocks: DataFrame, rows: int) -> np.ndarray:
    """Sorted shingles that stand as often as a SHARE of the documents at least,
    judged by the blocks that have them often.  The order of prefixes rests on them, never
    a result."""
    def spread(batches):
        for b in batches:
            for x in b.column("extra").to_pylist():
                n = len(x) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8", n)), pa.array(np.frombuffer(x, "<i4", n, 8 * n))], ["t", "n"])

    least = max(3, int(SHARE * rows))
    got = blocks.select("extra").mapInArrow(spread, "t long, n int").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.t for r in got.select("t").collect()], np.int64).view(U))


def often(shingle: int):
    """Summary of a block: shingles that stand in it often."""
    def count(b: BlockWords) -> bytes:
        value, n = np.unique(grams(b.hash, shingle)[b.starts(shingle)], return_counts=True)
        keep = n >= max(3, SHARE * (len(b.off) - 1))
        return value[keep].astype("<u8").tobytes() + n[keep].astype("<i4").tobytes()
    return count


def classes(docs: DataFrame, shingle: int, percent: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The blocks of the documents and ``(block, at, doc, n, comp)`` of every
    row: its place in the block, id, set size and class (null: empty set)."""
    spark = docs.sparkSession
    blocks = write_blocks(docs, often(shingle), carry=carry, lower=True)
    buckets = shuffle_partitions(spark)
    text = blocks.select("block", "doc_id", "size", "body")
    rows = blocks.select(F.size("doc_id").alias("n")).agg(F.sum("n")).first()[0] or 0
    sent = spark.sparkContext.broadcast(frequent_shingles(blocks, rows))

    def each(batch):
        for i in range(batch.num_rows):
            b = BlockWords(unpack(batch.column("size")[i].as_py(), batch.column("body")[i].as_py()), True)
            s = Sets(b, shingle, sent.value)
            _, nodes = np.unique(np.where(s.size > 0, s.id, -1), return_index=True)
            yield i, batch.column("block")[i].as_py(), s, nodes[s.size[nodes] > 0]

    def first_round(batches):
        for batch in batches:
            for i, block, s, nodes in each(batch):
                vec = s.vectors()
                detail = s.details()
                group = local_groups(s, nodes, vec, detail, percent)
                ids = batch.column("doc_id")[i].as_py()
                same = dict(zip(s.id[nodes].tolist(), group.tolist(), strict=True))
                head = np.array([s.id[nodes[same[x]]] if n else -1 for x, n in zip(s.id.tolist(), s.size.tolist(), strict=True)], np.int64)
                firsts = np.sort(nodes[np.unique(group)]) if len(nodes) else nodes
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, s.id.tolist(), head.tolist(), s.size.tolist())]
                blobs = [x for doc, token in (s.lowest(firsts), s.prefixes(nodes, percent)) for x in (doc.astype("<i4").tobytes(), token.tobytes())]
                blobs += [shrunk(vec), s.parities(percent).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, *(pa.array([x], pa.binary()) for x in blobs), pa.array([detail], pa.list_(pa.binary()))],
                                                 ["block", "doc", "own", "head", "n", "low_doc", "low", "prefix_doc", "prefix", "vec", "parity", "detail"])

    sketch = by_block(text.mapInArrow(first_round, "block long, doc array<bigint>, own array<bigint>, head array<bigint>, n array<bigint>, low_doc binary, low binary, "
                                      "prefix_doc binary, prefix binary, vec binary, parity binary, detail array<binary>"))
    members = (sketch.select("block", F.posexplode(F.arrays_zip("doc", "own", "head", "n")).alias("at", "r"))
               .select("block", "at", "r.doc", "r.own", "r.head", "r.n"))

    def known(batch, at: str = "prefix_doc", value: str = "prefix"):
        """Of each block: its ids, sizes, shingles to meet at (prefixes) and
        components (the ids themselves, as long as none are known), by document."""
        labels = "had" in batch.schema.names
        for i in range(batch.num_rows):
            ids, size = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("own", "n"))
            label = dict(zip(batch.column("had")[i].as_py() or (), batch.column("label")[i].as_py() or (), strict=True)) if labels else {}
            comp = np.array([label.get(x, x) for x in ids.tolist()], np.int64)
            doc, token = np.frombuffer(batch.column(at)[i].as_py(), "<i4"), np.frombuffer(batch.column(value)[i].as_py(), U)
            yield i, batch.column("block")[i].as_py(), ids, size, doc, token, comp

    def by_blocks(sent: DataFrame, meet, name: str) -> DataFrame:
        found = sent.groupBy("bucket").applyInArrow(meet, "block long, hot binary")
        return written(found.groupBy("block").agg(F.collect_list("hot").alias("hot")), name)

    def candidates(rows: DataFrame, at: str, value: str, hot: DataFrame | None, spanning: bool) -> DataFrame:
        """Candidate pairs at the shingles in the columns ``at`` and ``value``
        (those that are ``hot``, if given): by parities, what is left by counts."""
        def by_parity(batches):
            for batch in batches:
                for i, block, _, size, doc, token, comp in known(batch, at, value):
                    if "hot" in batch.schema.names:
                        hit = member(mix(short(token).astype(U), size[doc].astype(U)), marks_of(batch.column("hot")[i].as_py()))
                        doc, token = doc[hit], token[hit]
                    yield sketches(block, token, doc, size, comp, np.frombuffer(batch.column("parity")[i].as_py(), "<u8"), buckets, percent)

        def by_counts(batches):
            for batch in batches:
                for i, block, ids, size, doc, token, comp in known(batch, at, value):
                    hit = member(mix(short(token).astype(U), doc.astype(U)), marks_of(batch.column("hot")[i].as_py()))
                    vec = grown(batch.column("vec")[i].as_py(), len(ids), COARSE)
                    yield entries(block, token[hit], doc[hit], ids, size, vec, comp, buckets, batch.column("detail")[i].as_py())

        few = rows.drop("vec", "detail")
        left = by_blocks((few if hot is None else few.join(hot, "block")).mapInArrow(by_parity, SKETCH), alike(percent), "alike")
        return rows.drop("parity").join(left, "block").mapInArrow(by_counts, ENTRY).groupBy("bucket").applyInArrow(meeting(percent, spanning), PAIR)

    pairs = candidates(sketch.select("block", "own", "n", "low_doc", "low", "vec", "parity", "detail"), "low_doc", "low", None, True)
    links = verified(text, pairs, shingle, percent)
    local = members.where("n > 0 and own <> head").select(F.col("own").alias("a"), F.col("head").alias("b")).distinct()
    links = written(links.unionByName(local), "links")
    comps = components(links)

    # components of each block's sets, as lists that travel to the block
    of_block = (members.where("n > 0").select("block", "own").distinct().join(comps.withColumnRenamed("node", "own"), "own")
                .groupBy("block").agg(F.collect_list(F.struct("own", "label")).alias("both"))
                .select("block", F.col("both.own").alias("own"), F.col("both.label").alias("label")))
    of_block = written(of_block, "comps")

    def contested(batches):
        for batch in batches:
            for _, block, _, size, doc, token, comp in known(batch):
                _, kind = np.unique(np.stack([size, comp], 1), axis=0, return_inverse=True)  # documents alike in both are one
                before = np.arange(len(doc)) - np.searchsorted(doc, doc)
                order = np.lexsort((before, token, kind[doc]))
                both = np.stack([kind[doc], token.view(np.int64), before], 1)[order]
                both = both[np.concatenate([[True], (both[1:, 0] != both[:-1, 0]) | (both[1:, 1] != both[:-1, 1])])] if len(both) else both
                a_size, a_comp = np.empty(kind.max(initial=-1) + 1, np.int64), np.empty(kind.max(initial=-1) + 1, np.int64)
                a_size[kind], a_comp[kind] = size, comp
                token = both[:, 1].copy().view(U)
                rows_ = packed(np.arange(len(both)), bucket_of(token, buckets), buckets)
                cols: list[list] = [[] for _ in range(5)]
                for _, raw in rows_:
                    at = np.frombuffer(raw, np.int64)
                    own, count = np.unique(both[at, 0], return_counts=True)  # shingles lie by document
                    for col, x in zip(cols, (short(token[at]).tobytes(), shrunk(count), shrunk(both[at, 2]), shrunk(a_size[own]), a_comp[own].tobytes()), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows_], pa.int32()), pa.array([block] * len(rows_), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)],
                                                 ["bucket", "block", "tokens", "counts", "before", "sizes", "comps"])

    def several(table: pa.Table) -> pa.Table:
        """Tokens and sizes that meet another component at a size within reach
        (given how many shingles stand before the token), back to their blocks."""
        get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        wide = lambda c, rows: shrunk_lists(table.column(c).to_pylist(), rows)
        parts, comps_ = get("tokens", "<u4"), get("comps", "<i8")
        token, count = np.concatenate(parts), wide("counts", comps_)
        size, comp = np.repeat(wide("sizes", comps_), count), np.repeat(np.concatenate(comps_), count)
        # with i shingles before it, a first common shingle leaves n - i to share
        reach = (100 + percent) * (size - wide("before", parts)) // percent - size
        _, place = np.unique(token, return_inverse=True)
        hot = np.arange(len(token))
        for _ in range(3):  # a partner must be within reach itself, so what is left is looked at again
            order = hot[np.lexsort((comp[hot], size[hot], place[hot]))]
            at, n, c = place[order], size[order], comp[order]
            turn = np.concatenate([[0], np.cumsum((c[1:] != c[:-1]) & (at[1:] == at[:-1]))])  # changes of component so far
            scale = int(n.max(initial=0)) * 2 + 2
            key = at * scale + n
            most = np.minimum(np.minimum(100 * n // percent, reach[order]), scale - 1)
            lo = np.searchsorted(key, at * scale + -(-percent * n // 100), "left")
            hi = np.searchsorted(key, at * scale + most, "right") - 1
            if len(order):  # the window need not hold the entry itself: any component but its own will do
                first = np.minimum(lo, len(order) - 1)
                hot = order[(hi >= lo) & ((turn[np.maximum(hi, 0)] > turn[first]) | (c[first] != c))]
        mask = np.zeros(len(token), bool)
        mask[hot] = True
        hot = mask
        cut = np.cumsum([0, *map(len, parts)])
        # one number a token and size
        name = mix(token.astype(U), size.astype(U))
        out = [np.unique(name[a:b][hot[a:b]]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        keep = [i for i, x in enumerate(out) if x]
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())), "hot": pa.array([out[i] for i in keep], pa.binary())})

    labelled = (sketch.select("block", "own", "n", "prefix_doc", "prefix", "vec", "parity", "detail")
                .join(of_block.withColumnRenamed("own", "had"), "block", "left"))
    held = labelled.drop("vec", "parity", "detail").mapInArrow(contested, "bucket int, block long, tokens binary, counts binary, before binary, sizes binary, comps binary")
    pairs = candidates(labelled, "prefix_doc", "prefix", by_blocks(held, several, "contested"), False)
    comps = components(links.unionByName(written(verified(text, pairs, shingle, percent), "links")))

    rows_ = members.join(comps.withColumnRenamed("node", "own"), "own", "left").select(
        "block", "at", "doc", "n", F.when(F.col("n") > 0, F.coalesce("label", "own")).alias("comp"))
    return blocks, rows_


def join(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: its set's size and
    the smallest id that links reach (the row's own included).  Two rows link if
    ``100 * |A and B| >= percent * |A or B|``; words are lower-cased (A-Z).

    Null and empty texts have the empty set and link with nothing.  Rows with
    equal sets link.  Null ids are ignored in the smallest id unless alone.
    Further columns are ignored, an empty table gives an empty result, texts of
    any length are taken whole.  Shingles and sets are told apart by 64-bit
    hashes.
    """
    _, rows = classes(docs, shingle, percent, False)
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc").alias("component_id"))
    return rows.join(least, "comp", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their
    group (smallest id, null before all, then as they lie in the input).  Rows
    with an empty set stay."""
    blocks, rows = classes(docs, shingle, percent, True)
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", "block", "at")).alias("f")).select("f.block", "f.at")
    keep = first.unionByName(rows.where("comp is null").select("block", "at")).groupBy("block").agg(F.collect_list("at").alias("keep"))
    order = docs.columns

    def apply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = pa.array(sorted(batch.column("keep")[i].as_py()), pa.int64())
                text = unpack(batch.column("size")[i].as_py(), batch.column("body")[i].as_py())
                yield from rows_of(batch.column("rest")[i].as_py()).append_column("text", text).select(order).take(at).to_batches()

    return (blocks.select("block", "size", "body", "rest").join(written(keep, "kept"), "block")
            .mapInArrow(apply, docs.withColumn("text", F.col("text").cast("string")).schema))
