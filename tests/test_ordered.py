"""Order-dependent operators against sequential statements written here."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from murmur.operators.ordered import ordered_scan, with_row_index
from murmur.operators.phrases import merge_phrases
from murmur.operators.timeline import with_lagged_bins
from murmur.operators.topics import threshold_groups


def lagged_reference(fs):
    out, b = [], 0
    for i, f in enumerate(fs):
        if i > 0 and f > b:
            b += 1
        out.append(b)
    return out


def test_lagged_formula_cases():
    assert lagged_reference([0, 5, 5, 5, 6]) == [0, 1, 2, 3, 4]


def test_lagged_bins_random(spark):
    rnd = random.Random(5)
    t0 = datetime(2024, 1, 1)
    secs = sorted(rnd.sample(range(0, 10_000), 300))
    rows = [(i, t0 + timedelta(seconds=s)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    got = {r["id"]: r["bin"] for r in with_lagged_bins(df, "ts", "id").collect()}
    span = (secs[-1] - secs[0]) * 1_000_000
    w = span // 100
    fs = [((s - secs[0]) * 1_000_000) // w for s in secs]
    assert [got[i] for i in range(len(secs))] == lagged_reference(fs)


def test_row_index_and_prefix(spark):
    rnd = random.Random(1)
    vals = [(i, rnd.randint(0, 50), float(rnd.randint(-5, 5))) for i in range(500)]
    df = spark.createDataFrame(vals, "id long, k long, v double")
    out = ordered_scan(df, ["k", "id"], value="v", op="sum").collect()
    order = sorted(vals, key=lambda r: (r[1], r[0]))
    cum, exp = 0.0, {}
    for i, (id_, _, v) in enumerate(order):
        cum += v
        exp[id_] = (i, cum)
    assert {r["id"]: (r["_i"], r["_acc"]) for r in out} == exp
    idx = with_row_index(df, ["v", "id"], "rn").select("rn").collect()
    assert sorted(r["rn"] for r in idx) == list(range(500))


def greedy_merge(tokens, phrases):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in phrases:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_phrase_merge_flags(spark):
    # flags 1,1,1,0,1 -> merges at 0, 2, 4
    toks = ["a", "b", "c", "d", "e", "f"]
    ph = {("a", "b"), ("b", "c"), ("c", "d"), ("e", "f")}
    assert greedy_merge(toks, ph) == ["a_b", "c_d", "e_f"]
    docs = spark.createDataFrame([(1, toks)], "doc_id long, tokens array<string>")
    phr = spark.createDataFrame([(a, b) for a, b in ph], "a string, b string")
    got = [r["token"] for r in merge_phrases(docs, phr).orderBy("pos").collect()]
    assert got == ["a_b", "c_d", "e_f"]


def test_phrase_merge_random(spark):
    rnd = random.Random(3)
    vocab = list("abcd")
    docs = [(i, [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]) for i in range(60)]
    ph = {(a, b) for a in vocab for b in vocab if rnd.random() < 0.4}
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    phr = spark.createDataFrame(sorted(ph), "a string, b string")
    for most in (None, 3):  # in the arrays, and by a join
        got = {}
        for r in sorted(merge_phrases(df, phr, most=most).collect(), key=lambda r: (r["doc_id"], r["pos"])):
            got.setdefault(r["doc_id"], []).append(r["token"])
            assert r["pos"] == len(got[r["doc_id"]]) - 1
        for i, toks in docs:
            assert got.get(i, []) == greedy_merge(toks, ph)


def by_largest_neighbour(n, edges):
    """A topic opens the group of its chain of largest smaller neighbours, and
    lies in the group that its largest neighbour opens."""
    near = [[k for k in range(n) if (i, k) in edges or (k, i) in edges] for i in range(n)]

    def opens(i):
        smaller = [k for k in near[i] if k < i]
        return opens(max(smaller)) if smaller else i
    group = [opens(max(near[j], default=j)) for j in range(n)]
    return sorted([j for j in range(n) if group[j] == g] for g in set(group))


def groups_of(spark, n, edges):
    sim = spark.createDataFrame([(i, j, 1.0) for i, j in edges] or [(0, 0, 0.0)], "ti long, tj long, sim double")
    topics = spark.createDataFrame([(i,) for i in range(n)], "topic long")
    g = threshold_groups(sim, topics, 0.5).collect()
    inv = {}
    for r in g:
        inv.setdefault(r["grp"], []).append(r["topic"])
    return sorted(sorted(v) for v in inv.values())


def test_threshold_groups_case(spark):
    cases = [({(0, 2), (0, 3), (1, 2)}, [[0, 3], [1, 2]]), (set(), [[0], [1], [2], [3]]),
             ({(0, 1), (1, 2), (2, 3)}, [[0, 1, 2, 3]]), ({(0, 3), (1, 3)}, [[0, 1, 3], [2]])]
    for edges, want in cases:
        assert by_largest_neighbour(4, edges) == groups_of(spark, 4, edges) == want


def test_threshold_groups_random(spark):
    rnd = random.Random(11)
    for _ in range(4):
        n = 9
        edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.25}
        assert groups_of(spark, n, edges) == by_largest_neighbour(n, edges)


def test_time_bins_do_not_depend_on_session_zone(spark):
    import __spark_entry__ as E
    q = E.queries()
    sf = "/root/testdata/sf0.001"
    before = sorted(map(tuple, q["bin_topic_histogram"](spark, sf).collect()))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = sorted(map(tuple, q["bin_topic_histogram"](spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after


def test_scan_keeps_nullable_big_ids(spark):
    from murmur.operators.sampling import exact_split
    rows = [(946684800123456789, 1), (None, 2), (946684800123456791, 3)]
    got = exact_split(spark.createDataFrame(rows, "big long, doc_id long"), "doc_id", 0.5, seed=1)
    assert sorted((r.big or 0) for r in got.collect()) == [0, 946684800123456789, 946684800123456791]


def test_undated_rows_touch_no_other(spark):
    from pyspark.sql import functions as F
    from murmur.operators.timeline import with_lagged_bins
    df = spark.range(20).withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).withColumnRenamed("id", "doc_id")
    plain = {r.doc_id: r.bin for r in with_lagged_bins(df, "ts", "doc_id", 5).collect()}
    more = df.unionByName(spark.createDataFrame([(99, None)], "doc_id long, ts timestamp"))
    got = {r.doc_id: r.bin for r in with_lagged_bins(more, "ts", "doc_id", 5).collect()}
    assert got == plain | {99: None}


def test_components_of_a_long_chain(spark):
    from murmur.operators.topics import threshold_groups
    sim = spark.createDataFrame([(i, i + 1, 0.9) for i in range(70)], "ti long, tj long, sim double")
    topics = spark.range(72).withColumnRenamed("id", "topic")
    got = {r.topic: r.grp for r in threshold_groups(sim, topics, 0.5, mode="components").collect()}
    assert got == {i: 0 for i in range(71)} | {71: 1}


def test_backfill_reads_to_the_end(spark):
    from murmur.operators.relational import backfill, latest_by_id_range
    df = spark.range(1, 26)
    batches = [b.count() for b in backfill(lambda m: latest_by_id_range(df, "id", max_id=m, page_size=5, max_pages=2))]
    assert batches == [10, 10, 5]


def test_long_keyword_list_is_joined(spark, monkeypatch):
    import murmur.operators.relational as R
    monkeypatch.setattr(R, "MAX_INLINE_WORDS", 2)
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, []), (4, None)], "doc_id long, tokens array<string>")
    assert [r.doc_id for r in R.keyword_filter(df, ["b", "c", "d"]).collect()] == [1]


def test_topic_vectors_and_first_words(spark):
    from murmur.operators.topics import first_words, topic_vectors
    tw = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "none")], "topic long, word string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [10.0, 20.0])], "word string, vector array<double>")
    got = {(r.topic, r.dim): r.value for r in topic_vectors(tw, vectors).collect()}
    assert got == {(0, 0): 11.0, (0, 1): 22.0, (1, 0): 10.0, (1, 1): 20.0}
    words = spark.createDataFrame([(0, "x", 1), (0, "y", 3), (0, "w", 1), (1, "z", 2)], "cluster int, word string, df long")
    assert sorted(tuple(r) for r in first_words(words, 2).collect()) == [(0, 1, "y"), (0, 2, "w"), (1, 1, "z")]


def test_trigrams_are_phrases_of_merged_messages(spark):
    from murmur.operators.phrases import process_text
    docs = spark.createDataFrame([(k, ["new", "york", "city", f"w{k}"]) for k in range(30)] + [(99, [])], "doc_id long, tokens array<string>")
    two = {r.doc_id: r.tokens for r in process_text(docs, 2, 1.0).collect()}
    three = {r.doc_id: r.tokens for r in process_text(docs, 2, 1.0, 0.5).collect()}
    assert two[0] == ["new_york", "city", "w0"] and three[0] == ["new_york_city", "w0"] and three[99] == []


def test_phrases_are_counted_once(spark):
    """Scores are read from counts that were made once; messages without words,
    and no messages at all, have no phrases."""
    from murmur.operators.phrases import merge_phrases, phrase_scores
    docs = spark.createDataFrame([(i, ["new", "york", "x", f"w{i}"]) for i in range(12)] + [(99, [])], "doc_id long, tokens array<string>")
    found = phrase_scores(docs, 10, 1.0)
    # 15 words and 14 pairs; all but two pairs stand once
    v = 3 + 12 + 2 + 12
    assert {(r.a, r.b, r.n_ab, r.n_a, r.n_b) for r in phrase_scores(docs, 10, 0.0).collect()} == {("new", "york", 12, 12, 12), ("york", "x", 12, 12, 12)}
    assert abs(phrase_scores(docs, 10, 0.0).first().score - 2 / 144 * v) < 1e-12 and found.count() == 0
    plan = phrase_scores(docs, 10, 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "tokens" not in plan
    for none in (docs.where("doc_id = 99"), docs.where("doc_id > 100")):
        assert phrase_scores(none, 10, 0.0).count() == 0 and merge_phrases(none, phrase_scores(none, 10, 0.0)).count() == 0


def test_messages_go_to_workers_in_small_batches(spark):
    from murmur.operators.phrases import merged_arrays
    from murmur.session import ARROW_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.createDataFrame([(1, ["new", "york", "x"])], "doc_id long, tokens array<string>")
    out = merged_arrays(docs, spark.createDataFrame([("new", "york")], "a string, b string"))
    assert [r.tokens for r in out.collect()] == [["new_york", "x"]] and int(spark.conf.get(key)) == ARROW_BYTES
