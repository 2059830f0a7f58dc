"""Every registered query with an oracle matches DuckDB at sf0.001; the
others run and return rows.  Slow model queries are skipped here (they are
exercised by tools/check_oracle.py)."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from murmur.session import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"word2vec_fit", "w2v_shuffled", "w2v_message_blocks", "doc_vectors", "doc_topics", "dpgmm_doc_cluster_counts", "label_fraction_sweep",
        "cv_scores_lr", "cv_scores_svc", "grid_search", "train_test_scores"}
SQL = E.oracle_sql()
NAMES = [n for n in E.queries() if n not in SLOW]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v.is_integer() else v


def canon(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "rank", "token", "weight"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    exp = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert canon(got) == canon(exp)
