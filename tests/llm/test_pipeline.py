"""The pipeline stage by stage, and the registered queries with SQL."""

import duckdb
import pytest
from cases import linked_classes, shingles

import __spark_entry__ as E
import corpus_pipeline as C
from cases import words
from murmur.llm import langid, toxicity
from murmur.llm.common import documents, written
from murmur.llm.queries import ORACLE, QUERIES, remainder
from murmur.session import table
from test_dedup import kept_words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "substring_dedup", "packing"]
    docs = documents(spark, SF).cache()
    a = written(C.STAGES[0][1](spark, docs, SF), "t")
    machine = toxicity.train(docs.where(remainder() != 0), table(spark, SF, "labels"))
    good = {r.doc_id for r in toxicity.score(docs, machine).where("predicted = 0").collect()}
    assert {r.doc_id for r in a.collect()} == good and a.columns == docs.columns
    b = written(C.STAGES[1][1](spark, a, SF), "t")
    named = langid.identify(a, langid.train(a.where(remainder() != 0)))
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in named.where("lang_pred <> 'und' and score >= 0.4").collect()}
    c = written(C.STAGES[2][1](spark, b, SF), "t")
    rows = sorted((r.doc_id, r.text) for r in b.collect())
    classes = linked_classes([shingles(t, 5) for _, t in rows], lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y))
    assert sorted((r.doc_id, r.text) for r in c.collect()) == [r for k, r in enumerate(rows) if classes[k] == k]
    d = written(C.STAGES[3][1](spark, c, SF), "t")
    rows = sorted((r.doc_id, r.text) for r in c.collect())
    kept = kept_words(rows, 20)
    expected = {i: words(t) if len(kept[k]) == len(words(t)) else kept[k] for k, (i, t) in enumerate(rows) if kept[k] or not words(t)}
    assert {r.doc_id: words(r.text) for r in d.collect()} == expected and d.columns == docs.columns
    e = C.STAGES[4][1](spark, d, SF)
    assert {r.doc_id for r in e.collect()} == set(expected)


def test_registered():
    names = E.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES} and "pipeline" in names
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(expected, key=repr)


def test_working_tables_of_finished_steps_are_dropped(spark):
    import os
    from murmur.llm import common
    from murmur.llm.blocks import write_blocks
    docs = documents(spark, SF).limit(20)
    blocks = write_blocks(docs)
    first, second = written(docs, "a"), written(docs, "b")
    made = dict(common._MADE)
    common.release_all_but(second)
    there = {p for p in made if os.path.exists(p.replace("file:", ""))}
    assert there == set(common._MADE) and len(there) == 1 and second.count() == 20
    assert not any(spark.catalog.tableExists(t) for t in made.values() if t)
    with pytest.raises(Exception):
        blocks.count()
    assert first.schema == second.schema
