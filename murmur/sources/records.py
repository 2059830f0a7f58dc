"""Splittable scan of quoted CSV records, with repair of broken ones.

A quoted cell may hold line breaks, so where a record starts depends on every
quote before it.  A file is read in splits all the same:

1. Each split tells what it makes of its start, for both cases: that it starts
   between records, and that it starts inside a quoted cell.  Only lines with a
   quote matter; the answer is two bits a split.
2. A running composition of these answers over the splits of a file settles how
   each split really starts.
3. Each split is read again, now with its start known.  Records inside it are
   complete; what a split shares with its neighbours (the end of a cell that was
   open at its start, the record that is open at its end) is put together in a
   group a region.

What counts as broken:

* A quote that ends a cell must stand before a comma or the end of the line.
  If the first quote met inside a cell does not, that cell's own quote was a
  stray one: the line starts a record, and the lines since the stray quote are
  taken one by one.  So are the lines after a quote that nothing closes, and a
  region of more than ``limit`` characters.
* A record of several lines with too many cells is taken line by line if each
  line has enough of them, else as one record.
* In a line taken alone, a quote that nothing closes is left out.
* Too few cells: the rest is null.  Too many: the surplus goes back into the
  text cell if that was not quoted (its own commas had cut it), else it is left out.

Rows that are well formed are never touched.  Blank lines are no records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.session import on_workers

#: Characters of one record at most; a cell that stays open longer is not one.
RECORD_CHARS = 16 << 20
#: Characters of a piece of a region that travels as one row.
PIECE_CHARS = 1 << 20


def cells_of(record: str) -> tuple[list[tuple[str, bool]], int]:
    """The cells of a record as ``(value, quoted)``, and where a quote stands
    that nothing closes (-1: nowhere)."""
    out, at = [], 0
    while True:
        if record[at:at + 1] == '"':
            parts, start = [], at + 1
            while True:
                end = record.find('"', start)
                if end < 0:
                    return out, at
                if record[end + 1:end + 2] != '"':
                    break
                parts.append(record[start:end + 1])
                start = end + 2
            comma = record.find(",", end + 1)
            rest = record[end + 1:] if comma < 0 else record[end + 1:comma]
            out.append(("".join(parts) + record[start:end] + rest, True))
        else:
            comma = record.find(",", at)
            out.append((record[at:] if comma < 0 else record[at:comma], False))
        if comma < 0:
            return out, -1
        at = comma + 1


def after_line(line: str, inside: bool) -> tuple[bool, bool]:
    """Whether the line ends inside a quoted cell, if it starts so or not, and
    whether it shows that the cell it started in was none."""
    if not inside:
        return cells_of(line)[1] >= 0, False
    at = line.find('"')
    while at >= 0 and line[at + 1:at + 2] == '"':
        at = line.find('"', at + 2)
    if at < 0:
        return True, False
    follows = line[at + 1:at + 2]
    if follows in ("", "\r"):
        return False, False
    if follows == ",":
        return cells_of(line[at + 2:])[1] >= 0, False
    return cells_of(line)[1] >= 0, True


# ---- records from lines -----------------------------------------------------------

class Repair:
    """Cells of the records of a file with ``width`` cells a record; the surplus
    of a broken one goes into cell ``text``."""

    def __init__(self, width: int, text: int, limit: int = RECORD_CHARS):
        self.width, self.text, self.limit = width, text, limit

    def fitted(self, cells: list[tuple[str, bool]]) -> list[str | None]:
        more = len(cells) - self.width
        values = [c for c, _ in cells]
        if more > 0 and not cells[self.text][1]:
            values[self.text:self.text + more + 1] = [",".join(values[self.text:self.text + more + 1])]
        return (values + [None] * -more)[:self.width]

    def unquoted(self, line: str) -> list[tuple[str, bool]]:
        cells, stray = cells_of(line)
        while stray >= 0:
            line = line[:stray] + line[stray + 1:]
            cells, stray = cells_of(line)
        return cells

    def alone(self, line: str) -> Iterator[list[str | None]]:
        line = line.removesuffix("\r")
        if not line:
            return
        if '"' not in line:
            cells = line.split(",")
            yield cells if len(cells) == self.width else self.fitted([(c, False) for c in cells])
        else:
            yield self.fitted(self.unquoted(line))

    def closed(self, lines: list[str]) -> Iterator[list[str | None]]:
        """Records of lines that quoted cells hold together."""
        cells, _ = cells_of("\n".join(lines).removesuffix("\r"))
        if len(cells) > self.width and all(len(self.unquoted(x)) >= self.width for x in lines):
            for line in lines:
                yield from self.alone(line)
        else:
            yield self.fitted(cells)

    def region(self, lines: list[str], closed: bool) -> Iterator[list[str | None]]:
        if closed and sum(map(len, lines)) <= self.limit:
            yield from self.closed(lines)
        else:
            for line in lines:
                yield from self.alone(line)


class Split:
    """The lines of one split, in order: whole records, and what it shares with
    its neighbours."""

    def __init__(self, repair: Repair, inside: bool):
        self.repair, self.inside, self.lines, self.head, self.ended, self.size, self.over = repair, inside, [], inside, None, 0, False
        self.pieces = []

    def flush(self, final: bool) -> None:
        """Hand a piece of the region at the start or end of the split on."""
        if self.lines or final:
            self.pieces.append((0 if self.head else 1, list(self.lines), self.ended))
            self.lines, self.size = [], 0

    def add(self, line: str) -> Iterator[list[str | None]]:
        if not self.inside:
            if '"' in line and after_line(line, False)[0]:
                self.lines, self.size, self.inside, self.over = [line], len(line), True, False
            else:
                yield from self.repair.alone(line)
            return
        ends, stray = after_line(line, True) if '"' in line else (True, False)
        if not stray:
            self.lines.append(line)
            self.size += len(line)
            if ends and self.size > PIECE_CHARS:
                if self.head:
                    self.flush(False)
                elif self.size > self.repair.limit:  # too long for a cell, whatever follows
                    self.over = True
            if self.over:
                for x in self.lines:
                    yield from self.repair.alone(x)
                self.lines = []
            if ends:
                return
        if self.head:
            self.ended = "stray" if stray else "closed"
            self.flush(True)
            self.head, self.ended = False, None
        else:
            yield from self.repair.region(self.lines, not stray and not self.over)
        self.lines, self.size, self.inside, self.over = [], 0, False, False
        if stray:
            yield from self.add(line)

    def end(self) -> None:
        if not self.inside:
            return
        if self.over:  # the region was taken apart; the next split goes on with it
            self.pieces.append((1, [], "over"))
            return
        lines, size, cut = self.lines, 0, 0
        for k, line in enumerate(lines):
            size += len(line)
            if size > PIECE_CHARS:
                self.pieces.append((0 if self.head else 1, lines[cut:k + 1], None))
                size, cut = 0, k + 1
        self.pieces.append((0 if self.head else 1, lines[cut:], None))


def by_split(batches, step: Callable[[str, int], object]) -> Iterator:
    """An object of its own for each split, made by ``step(inside)``: yields
    ``(object, line, False)`` for each line and ``(object, None, True)`` at its end."""
    now, key = None, None
    for batch in batches:
        files, starts = batch.column("file"), batch.column("start")
        lines = batch.column("line").to_pylist()
        inside = batch.column("inside").to_pylist() if "inside" in batch.schema.names else [None] * len(lines)
        for file, start, line, state in zip(files.to_pylist(), starts.to_pylist(), lines, inside, strict=True):
            if (file, start) != key:
                if now is not None:
                    yield now, None, True
                now, key = step(state), (file, start)
                now.place = key
            yield now, line, False
    if now is not None:
        yield now, None, True


# ---- the scan -----------------------------------------------------------------------

def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, line)``: lines in the order of the file, ``start`` being
    where their split starts in it."""
    t = spark.read.option("lineSep", "\n").text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.make_valid_utf8("value").alias("line"))


class Transition:
    """What a split makes of its start (a line without a quote comes as None)."""

    def __init__(self, _):
        self.to = [False, True]

    def add(self, line: str | None) -> None:
        if line is None:
            return
        from_out, from_in = after_line(line, False)[0], after_line(line, True)[0]
        self.to = [from_in if x else from_out for x in self.to]


def transitions(lines: DataFrame) -> DataFrame:
    """``(file, start, out_to, in_to)`` of each split."""
    def run(batches):
        for split, line, done in by_split(batches, Transition):
            if not done:
                split.add(line)
                continue
            (file, start), (a, b) = split.place, split.to
            yield pa.RecordBatch.from_pydict({"file": [file], "start": pa.array([start], pa.int64()), "out_to": [a], "in_to": [b]})

    quoted = lines.select("file", "start", F.when(F.contains("line", F.lit('"')), F.col("line")).alias("line"))
    return quoted.mapInArrow(run, "file string, start long, out_to boolean, in_to boolean")


def starts_inside(lines: DataFrame) -> DataFrame:
    """``(file, start, inside)`` of the splits that start inside a cell.  A split
    whose answer is the same for both starts settles all before it; from there
    on, only the number of splits that turn one into the other counts."""
    every = transitions(lines)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.when(F.col("out_to") == F.col("in_to"), F.col("in_to"))
    turns = F.when(F.col("out_to") & ~F.col("in_to"), 1).otherwise(0)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    scan = every.withColumn("_t", F.sum(turns).over(upto))
    scan = scan.select("file", "start",
                       F.last(F.when(settled.isNotNull(), F.struct(settled.alias("s"), F.col("_t").alias("t"))), ignorenulls=True).over(before).alias("_s"),
                       F.coalesce(F.max("_t").over(before), F.lit(0)).alias("_n"))
    odd = (F.col("_n") - F.coalesce(F.col("_s.t"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("_s.s"), F.lit(False)) != odd
    return scan.select("file", "start", inside.alias("inside")).where("inside")


def read_records(spark: SparkSession, path: str, header: list[str], skip_header: bool = True, limit: int = RECORD_CHARS) -> DataFrame:
    """The records of the CSV files at ``path`` as one string column a name of
    ``header``; many tasks a file, no record lost."""
    width, text = len(header), header.index("text") if "text" in header else len(header) - 1
    lines = lines_of(on_workers(spark), path)
    # at most a row a split, i.e. one in spark.sql.files.maxPartitionBytes of input
    known = lines.join(F.broadcast(starts_inside(lines)), ["file", "start"], "left").select("file", "start", "line", F.coalesce("inside", F.lit(False)).alias("inside"))

    def splits(batches):
        repair = Repair(width, text, limit)
        first = None
        for split, line, done in by_split(batches, lambda inside: Split(repair, inside)):
            if done:
                split.end()
                yield split, None
                continue
            if split is not first:
                first = split
                if split.place[1] == 0:
                    line = line.removeprefix("﻿")
                    if skip_header:
                        continue
            yield split, split.add(line)

    def whole(batches):
        rows = []
        for split, got in splits(batches):
            if got is not None:
                rows += got
            split.pieces = []
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["cells"])
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["cells"])

    def shared(batches):
        for split, got in splits(batches):
            if got is not None:
                for _ in got:
                    pass
            for k, (role, part, ended) in enumerate(split.pieces):
                split.piece = getattr(split, "piece", 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split.place[0]]), pa.array([split.place[1]], pa.int64()), pa.array([role], pa.int32()), pa.array([split.piece], pa.int64()),
                     pa.array([sum(map(len, part))], pa.int64()), pa.array([ended], pa.string()), pa.array([part], pa.list_(pa.string()))],
                    ["file", "start", "role", "piece", "chars", "ended", "lines"])
            split.pieces = []

    pieces = known.mapInArrow(shared, "file string, start long, role int, piece long, chars long, ended string, lines array<string>")
    order = Window.partitionBy("file").orderBy("start", "piece")
    opens = (F.col("role") == 1) & (F.coalesce(F.lag("role").over(order), F.lit(0)) == 0)
    opens = opens | ((F.col("role") == 1) & (F.lag("start").over(order) != F.col("start")))
    regions = pieces.withColumn("_o", opens.cast("int")).withColumn("region", F.sum("_o").over(order))
    of = Window.partitionBy("file", "region")
    closed = F.max((F.col("ended") == "closed").cast("int")).over(of) == 1
    closed = F.coalesce(closed, F.lit(False)) & ~F.coalesce(F.max((F.col("ended") == "over").cast("int")).over(of) == 1, F.lit(False))
    joined = regions.withColumn("closed", closed & (F.sum("chars").over(of) <= limit))
    # a region that holds together is one group; the others go piece by piece
    alone = F.when(F.col("closed"), F.lit(-1)).otherwise(F.monotonically_increasing_id())

    def resolve(table: pa.Table) -> pa.Table:
        repair = Repair(width, text, limit)
        table = table.sort_by([("start", "ascending"), ("piece", "ascending")])
        rows = repair.region([x for part in table.column("lines").to_pylist() for x in part], table.column("closed")[0].as_py())
        return pa.table({"cells": pa.array(list(rows), pa.list_(pa.string()))})

    tails = joined.withColumn("alone", alone).groupBy("file", "region", "alone").applyInArrow(resolve, "cells array<string>")
    rows = known.mapInArrow(whole, "cells array<string>").unionByName(tails)
    return rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(header)])
