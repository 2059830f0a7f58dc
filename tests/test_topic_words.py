"""Topic words: rows meet their source where they lie, repeated ids meet all of theirs."""

from pyspark.sql import functions as F

from murmur.operators import topics as TP
from murmur.operators import vocab as V
from murmur.plans.q_topics import source_bags

ROWS = [(1, "a", ["x", "y", "x"]), (2, "b", ["x"]), (3, "a", []), (4, None, ["z"]), (None, "b", ["q"]),
        (5, "a", ["x", "w"]), (5, "b", ["w"]), (6, "b", ["v"]), (6, "b", ["v"]), (7, "b", None)]


def test_bags_of_sources_are_those_of_a_join_by_id(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, source string, tokens array<string>")
    want = V.bag_of_words(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source", "token").agg(F.sum("tf").alias("n")).collect()
    bags = source_bags(rows)
    got = bags.groupBy("source", "token").agg(F.sum("tf").alias("n")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 7
    # no message's words are sent to meet a source: the joins are with the few repeated ids
    plan = bags.limit(0).sparkSession._jvm.PythonSQLUtils.explainString(bags._jdf.queryExecution(), "formatted")
    assert "BroadcastHashJoin LeftAnti" in plan


def test_words_of_a_topic_are_read_once(spark):
    rows = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), (None, "z", 5)], "topic string, token string, tf long")
    words = TP.topic_words(rows, count_col="tf")
    assert {(r.topic, r.word, r.weight) for r in words.collect()} == {("a", "x", 0.75), ("a", "y", 0.25), ("b", "x", 1.0)}
    plan = words.sparkSession._jvm.PythonSQLUtils.explainString(words._jdf.queryExecution(), "formatted")
    assert "Join" not in plan
