"""Fill-in-the-middle transformation with an indexable skip list.

A text is cut into lines.  They are the nodes of a skip list whose links carry
two widths: how many lines and how many code points they pass.  Lane 0 links
every line to the next; a line stands in lane k if a hash of its number has k
trailing zeros in base ``FAN``, and an express link is as wide as the links below
it together.  To find where a rank lies, a search starts in the highest lane and
takes a link as long as its line width stays within the rank; the code points it
passed on the way are the place to cut.  Ranks are drawn from sha256 of the
document's id, so a recomputed task cuts alike.

Empty tables give empty tables; a null text is an empty text; an empty text and
one that holds a mark stay as they are (``plain``).  A null id is hashed as
empty text.  Rows are independent, so equal ids and equal texts are no special case,
and further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import map_slices, texts, with_id

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One line in ``FAN`` stands in the next lane, too.
FAN = 8


class SkipList:
    """Nodes with code-point widths, indexable by their rank.

    ``lanes[k]`` holds, for each node of lane ``k`` (the head, node 0, stands in
    all), how many nodes and how many code points its link passes, and where the
    node stands in the lane below."""

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        units, chars = np.ones(self.n, np.int64), np.asarray(widths, np.int64)
        self.lanes = [(units.tolist(), chars.tolist(), None)]
        tower = heights(self.n)
        while len(units) > FAN:
            stays = tower > 0
            stays[:1] = True
            at = np.flatnonzero(stays)
            if len(at) == len(units):
                break
            units, chars, tower = np.add.reduceat(units, at), np.add.reduceat(chars, at), tower[at] - 1
            self.lanes.append((units.tolist(), chars.tolist(), at.tolist()))

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` nodes."""
        left, passed, at = rank, 0, 0
        for units, chars, below in reversed(self.lanes):
            while at < len(units) and units[at] <= left:
                left -= units[at]
                passed += chars[at]
                at += 1
            if not left:
                break
            if below is not None:
                at = below[at]
        return passed


def heights(n: int) -> np.ndarray:
    """Lanes above lane 0 that each node stands in, by a hash of its number."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    up, live = np.zeros(n, np.int64), np.ones(n, bool)
    while True:
        live = live & (x % np.uint64(FAN) == 0)
        if not live.any():
            return up
        up += live
        x //= np.uint64(FAN)
        live &= x > 0


def line_widths(text: str) -> np.ndarray:
    """Code points of each line, its line feed counted with it."""
    parts = text.split("\n")
    widths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def draws(doc_id, seed: int) -> list[int]:
    """The four numbers that decide about a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, doc_id, seed: int, percent: int, spm_percent: int) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)`` of one document."""
    widths = line_widths(text) if text else np.empty(0, np.int64)
    n = len(widths)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lines = SkipList(widths)
    a, b = sorted((lines.chars_before(h1 % (n + 1)), lines.chars_before(h2 % (n + 1))))
    head, mid, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}"
    return n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}"


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``(doc_id, n long, form string, prefix_chars long, middle_chars long,
    output string)`` of every document: its lines cut at two drawn ranks and put
    in the order prefix, suffix, middle (``psm``) or suffix, prefix, middle
    (``spm``) with a mark before each, or left ``plain``.  ``percent`` of the
    documents are cut, ``spm_percent`` of those suffix first."""
    schema = with_id(docs, "n long, form string, prefix_chars long, middle_chars long, output string")

    def start():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("doc_id")
            rows = [rearranged(t, i, seed, percent, spm_percent) for t, i in zip(texts(batch).to_pylist(), ids.to_pylist(), strict=True)]
            n, form, head, mid, out = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(head, pa.int64()),
                 pa.array(mid, pa.int64()), pa.array(out, pa.string())], schema.fieldNames())
        return part

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", schema, start)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone.
    No mark stands inside the parts, so the first of each kind ends a part."""
    out = F.col(output)

    def between(left: str, right: str) -> Column:
        after = F.substr(out, F.instr(out, left) + len(left))
        return F.substring_index(after, right, 1)

    mid = F.substr(out, F.instr(out, MIDDLE) + len(MIDDLE))
    return (F.when(F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), mid, between(SUFFIX, MIDDLE)))
            .when(F.col(form) == "spm", F.concat(between(PREFIX, MIDDLE), mid, between(SUFFIX, PREFIX)))
            .otherwise(out))
