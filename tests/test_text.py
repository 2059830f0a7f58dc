"""Text rules on hand-computed inline cases."""

import pytest
from pyspark.sql import functions as F

from murmur.functions.text import clean_and_tokenize, normalize_punctuation, split_words, valid_tokens


def tokens(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(split_words(normalize_punctuation(F.col("t"), **kw)).alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    ("see http://t.co/é now", ["see", "URL", "/", "é", "now"]),
    ("@josé hi", ["USER", "é", "hi"]),
    ("http://a.b/c. x", ["URL", ".", "x"]),
    ("@ x", ["@", "x"]),
    ("a:b", ["a", ":", "b"]),
    ("a b", ["a", "b"]),
    ("Hello, World!!", ["hello", ",", "world", "!", "!"]),
    ("abc123def #tag", ["abc", "123", "def", "tag"]),
    ("x‰ay", ["x", "‰a", "y"]),
])
def test_tokenize_cases(spark, text, expected):
    assert tokens(spark, text) == expected


def test_rt_flag_and_validity(spark):
    df = spark.createDataFrame([("RT @bob: the cat a sat",)], "t string")
    out = df.select(clean_and_tokenize(F.col("t"), ["the"], rt=True).alias("x")).first()["x"]
    assert out == ["USER", "cat", "sat"]
    keep = df.select(valid_tokens(split_words(normalize_punctuation("t")), None, keep_all=True).alias("x")).first()["x"]
    assert keep == ["rt", "USER", ":", "the", "cat", "a", "sat"]


def test_collapse_spaces(spark):
    df = spark.createDataFrame([("  A  b  ",)], "t string")
    assert df.select(normalize_punctuation("t").alias("x")).first()["x"] == "a b"


def test_tokens_read_in_one_pass_equal_the_rules_one_by_one(spark):
    """Kept tokens, read off the tagged text, are those of the rules and the split."""
    import random

    from murmur.functions import text as X
    random.seed(5)
    parts = list("abzABZ019 é\u0085　  \t\n\r\x0b\x1c#@_-.,:!?'\"‰aâÂ…‘’«»İßΣ𝒜😀\\[]^`~=*+/;()日本٣") + ["http", "http://", "@", "rt", "the", "‰a", "  ", "www.x"]
    rows = [("".join(random.choice(parts) for _ in range(random.randint(0, 30))),) for _ in range(3000)] + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "text string")
    stop = ["the", "ab"]
    plain = X.valid_tokens(X.split_words(X.normalize_punctuation(F.translate("text", "\n\r", " "))), stop)
    got = X.clean_and_tokenize(X.normalize_format("text"), stop)
    assert docs.where(~plain.eqNullSafe(got)).count() == 0


def test_a_rule_does_not_repeat_the_text_before_it(spark):
    """Each rule that looks at the text first gets it computed once."""
    from murmur.functions import text as X
    docs = spark.range(1).select(F.col("id").cast("string").alias("text"))
    for rule in (X.normalize_punctuation("text"), X.clean_and_tokenize("text", ["the"])):
        assert str(docs.select(rule.alias("t"))._jdf.queryExecution().analyzed()).count("lower(text") <= 1


def test_bags_are_sorted_natively_and_read_once(spark):
    from murmur.operators import vocab as V
    from murmur.plans import q_files
    docs = spark.createDataFrame([(1, ["b", "a", "b", "\u00e4", "Z"]), (2, []), (3, None), (4, [None, "a", None])], "doc_id long, tokens array<string>")
    bags = V.with_token_counts(docs)
    got = {r.doc_id: [(c.token, c.tf) for c in r._bag or []] for r in bags.collect()}
    assert got == {1: [("Z", 1), ("a", 1), ("b", 2), ("\u00e4", 1)], 2: [], 3: [], 4: [("a", 3)]}
    plan = bags._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    assert "InMemoryRelation" in q_files.train_and_test(spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
