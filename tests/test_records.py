"""Splittable record scan: well-formed files as they are, broken ones repaired,
and neither depends on where a file is split."""

import csv
import io
import os
import random
import tempfile

import pytest

from murmur.sources.io import read_messages
from murmur.sources.records import Repair, Split, after_line, cells_of, lines_of, read_records

HEAD = ["id_str", "text", "label"]


def written(text: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="murmur-test-"), "m.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def random_rows(seed, n):
    r = random.Random(seed)
    parts = ["a", "b ", " ", '"', '""', ",", "\n", "\r\n", "é", "word", "7,x,y"]
    return [(str(k), "".join(r.choice(parts) for _ in range(r.randrange(20))), r.choice("xyz")) for k in range(n)]


def as_csv(rows):
    b = io.StringIO(newline="")
    csv.writer(b).writerows([HEAD, *rows])
    return b.getvalue()


def at_once(text, limit=1 << 24):
    """The records of a file taken as a single split."""
    repair = Repair(3, 1, limit)
    split, out = Split(repair, False), []
    lines = text.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        out += split.add(line)
    split.end()
    if split.inside:
        for line in (x for _, part, _ in split.pieces for x in part):
            out += repair.alone(line)
    return out[1:]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", ["128m", "3k", "250b"])
def test_well_formed_rows_are_untouched(spark, small_splits, size):
    small_splits(size)
    rows = random_rows(1, 1500)
    path = written(as_csv(rows))
    assert rows_of(read_records(spark, path, HEAD)) == sorted(rows, key=repr)
    if size != "128m":
        assert lines_of(spark, path).select("file", "start").distinct().count() > 5


@pytest.mark.parametrize("seed", range(3))
def test_splits_do_not_change_the_repair(spark, small_splits, seed):
    r = random.Random(seed)
    lines = as_csv(random_rows(seed, 300)).split("\n")
    for _ in range(60):
        k = r.randrange(1, len(lines))
        lines[k] = r.choice(['9,"open, text,a', '9,un,quoted,text,b', "9,short", 'say "hi', '9,"a\nb",c,surplus', '"', '9,"""', "", lines[k] + '"'])
    text = "\n".join(lines)
    want = sorted(map(tuple, at_once(text)), key=repr)
    path = written(text)
    for size in ("128m", "2k", "200b"):
        small_splits(size)
        assert rows_of(read_records(spark, path, HEAD)) == want


def test_an_unclosed_quote_costs_no_row(spark, small_splits):
    rows = [f"{k},text {k},l" for k in range(4000)]
    rows[10] = '10,"stray, quote,l'
    want = sorted((str(k), f"text {k}" if k != 10 else "stray, quote", "l") for k in range(4000))
    path = written("\n".join([",".join(HEAD), *rows]))
    for size, limit in (("128m", 1 << 24), ("4k", 1 << 24), ("4k", 900), ("128m", 900)):
        small_splits(size)
        assert rows_of(read_records(spark, path, HEAD, limit=limit)) == sorted(want, key=repr)


@pytest.mark.parametrize("text,want", [
    ('1,"see list\n12, one, two, three",a', [("1", "see list\n12, one, two, three", "a")]),
    ('1,"a, b, c\n2,foo,bar\nlast",z', [("1", "a, b, c\n2,foo,bar\nlast", "z")]),
    ('1,"open, text,a', [("1", "open, text", "a")]),
    ('1,"open, text,a\n2,"two\nlines",b', [("1", "open, text", "a"), ("2", "two\nlines", "b")]),
    ('1,say "hi" there,a', [("1", 'say "hi" there', "a")]),
    ('1,one, two, three,a', [("1", "one, two, three", "a")]),
    ('1,"x,y",a,surplus', [("1", "x,y", "a")]),
    ('1,"two\nlines",a,surplus', [("1", "two\nlines", "a")]),
    ("1", [("1", None, None)]),
    ("1,\n\n2,b,c\r\n", [("1", "", None), ("2", "b", "c")]),
    ("", []),
])
def test_cases(spark, text, want):
    assert rows_of(read_records(spark, written("id_str,text,label\n" + text), HEAD)) == sorted(want, key=repr)


def test_messages_are_cleaned_after_the_scan(spark):
    path = written('id_str,text,created_at,label\n 1 ,"two\r\nlines, here",2017-01-02,a\n')
    row = read_messages(spark, path).first()
    assert (row.id_str, row.text, row.label) == ("1", "two lines, here", "a") and row.created_at is not None


def test_line_states():
    assert cells_of('a,"b ""c"", d",e')[0] == [("a", False), ('b "c", d', True), ("e", False)]
    assert after_line('x "y" z', False) == (False, False)
    assert after_line('x,"y', False) == (True, False)
    assert after_line("no quote", True) == (True, False)
    assert after_line('end",b', True) == (False, False)
    assert after_line('end","b', True) == (True, False)
    assert after_line('2,"text",b', True) == (False, True)
    assert after_line('2,"text', True) == (True, True)
    assert after_line('still ""open"" here', True) == (True, False)
