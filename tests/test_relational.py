"""Id-range paging and id-list labelling on inline tables."""

from pyspark.sql import functions as F

from murmur.operators.relational import label_by_membership, latest_by_id_range, next_cursor


def test_id_range_pages_and_cursor(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(1, 301)], "id long, t string")
    page = latest_by_id_range(df, "id", since_id=20, max_id=250, match=F.col("t") == "x",
                              page_size=10, max_pages=3)
    rows = page.orderBy(F.col("id").desc()).collect()
    ids = [r["id"] for r in rows]
    expected = [i for i in range(250, 20, -1) if i % 3][:30]
    assert ids == expected
    assert [r["page"] for r in rows] == [k // 10 for k in range(30)]
    assert next_cursor(page, "id").first()["oldest_id"] == min(expected)


def test_label_by_membership_duplicates(spark):
    msgs = spark.createDataFrame([(1,), (2,), (3,)], "id_str long")
    pos = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    got = {r["id_str"]: r["label"] for r in label_by_membership(msgs, pos, "id_str").collect()}
    assert got == {1: "F", 2: "T", 3: "F"}
