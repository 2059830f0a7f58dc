"""CSV message reader: quoting, bad bytes, short/long rows, glued records."""

import os
import tempfile

from murmur.sources.io import read_messages


def write(tmp, name, data: bytes):
    p = os.path.join(tmp, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_clean_csv(spark):
    tmp = tempfile.mkdtemp(prefix="murmur-test-")
    p = write(tmp, "a.csv", b'id_str,text,created_at\r\n'
                            b'1,"say ""hi""",2017-01-02 10:00:00\r\n'
                            b'2,"two\r\nlines",Mon Jan 02 10:00:00 +0000 2017\r\n'
                            b'3,"bad \xff byte",2017-01-02\r\n')
    rows = {r["id_str"]: r for r in read_messages(spark, p, ["id_str", "text", "created_at"]).collect()}
    assert rows["1"]["text"] == 'say "hi"'
    assert rows["2"]["text"] == "two lines"
    assert rows["2"]["created_at"] is not None
    assert rows["3"]["text"] == "bad � byte"


def test_short_and_long_rows(spark):
    tmp = tempfile.mkdtemp(prefix="murmur-test-")
    p = write(tmp, "b.csv", b'id_str,text,created_at\n3,short\n5,"x,y",2017,extra\n')
    rows = {r["id_str"]: r for r in read_messages(spark, p, ["id_str", "text", "created_at"]).collect()}
    assert rows["3"]["text"] == "short" and rows["3"]["created_at"] is None
    assert rows["5"]["text"] == "x,y"


def test_missing_field_raises(spark):
    tmp = tempfile.mkdtemp(prefix="murmur-test-")
    p = write(tmp, "c.csv", b"id_str,text\n1,a\n")
    try:
        read_messages(spark, p, ["id_str", "label"])
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_every_glued_record_is_kept(spark):
    tmp = tempfile.mkdtemp(prefix="murmur-test-")
    p = write(tmp, "d.csv", b'id_str,text\n1,a "b,x\n2,"open,y\n3,ok,z\n4,ok\n5,ok\n')
    got = {r["id_str"] for r in read_messages(spark, p, ["id_str", "text"]).collect()}
    assert got == {"1", "2", "3", "4", "5"}


def test_score_log_numbers_trimmed_names(spark):
    from murmur.sources.io import read_score_log
    tmp = tempfile.mkdtemp(prefix="murmur-test-")
    row = "{t},{i},{n},1,1.0,0.3,1,1.0,1.0,1.0,1.0,1.0,1.0,0,lr\n"
    p = write(tmp, "log.csv", "".join(row.format(t=t, i=i, n=n) for t, i, n in
                                      ((0, 1, "a"), (1, 0, " a"), (0, 0, "b"), (0, 0, "c"))).encode())
    got = {(r["name"], r["name_id"]) for r in read_score_log(spark, p).collect()}
    assert got == {("b", 1), ("c", 2), ("a", 3)}


def test_materialize_keeps_what_is_there(spark):
    from murmur.sources.io import materialize
    from murmur.sources.store import load_or_fit
    path = os.path.join(tempfile.mkdtemp(prefix="murmur-test-"), "t")
    assert materialize(spark.range(3), path).count() == 3
    assert materialize(spark.range(5), path).count() == 3
    from pyspark.ml.feature import StandardScaler, StandardScalerModel
    from pyspark.ml.linalg import Vectors
    fits = []

    def fit():
        fits.append(1)
        return StandardScaler(inputCol="v", outputCol="z").fit(spark.createDataFrame([(Vectors.dense([1.0]),), (Vectors.dense([3.0]),)], ["v"]))
    a, b = (load_or_fit(spark, path + "-model", StandardScalerModel.load, fit) for _ in range(2))
    assert len(fits) == 1 and a.std == b.std
    # a fit cut short left a model that was never published
    StandardScaler(inputCol="v", outputCol="z").fit(spark.createDataFrame([(Vectors.dense([1.0]),), (Vectors.dense([3.0]),)], ["v"])).save(path + "-cut/model-x")
    assert load_or_fit(spark, path + "-cut", StandardScalerModel.load, fit).std == a.std and len(fits) == 2


def test_written_but_unread_formats(spark):
    from murmur.functions.plotdata import date_label, legend_lines, one_series, rows_where
    from murmur.sources import io as IO
    from pyspark.sql import functions as F
    tmp = tempfile.mkdtemp(prefix="murmur-test-")
    words = IO.read_word_list(spark, write(tmp, "w.txt", b" one \n\ntwo\n"))
    assert [r[0] for r in words.collect()] == ["one", "two"]
    probe = IO.read_probe_words(spark, write(tmp, "p.txt", b"a b : c\nd\n")).collect()
    assert [(r.positive, r.negative) for r in probe] == [(["a", "b"], ["c"]), (["d"], [])]
    write(tmp, "x_1.doc", b"hello\nthere")
    assert [r.text for r in IO.read_text_corpus(spark, tmp, "x_").collect()] == ["hello\nthere"]
    IO.write_json(spark.createDataFrame([(1, "a")], "k long, v string"), f"{tmp}/j")
    assert spark.read.json(f"{tmp}/j").first().v == "a"
    lab = IO.labelled_for_output(spark.createDataFrame([("1", "x", 1), ("2", "y", 0)], "id_str string, text string, label int"))
    assert [r.label for r in lab.collect()] == ["T", "F"]
    s = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0), ("a", None, 4.0)], "name string, x int, y double")
    assert one_series(s, "a", "x", "y").count() == 2
    assert rows_where(s, {"name": ["a", "b"], "x": 1}).count() == 2 and rows_where(s, {"x": None}).count() == 1
    assert s.select(date_label(F.lit("2024-03-05").cast("timestamp")).alias("d")).first().d == "03-05"
    lines = legend_lines(spark.createDataFrame([("g", i, "w" * 40) for i in range(5)], "k string, o int, word string"), "k", "o")
    assert lines.count() == 2


def test_names_of_cleaned_files():
    from murmur.sources.io import cleaned_name
    assert cleaned_name("/d/messages.csv", ["id_str", "text"]) == "/d/messages_short_id_str_text"
    assert cleaned_name("/d.x/messages", ["text"], by="id_str") == "/d.x/messages_short_sorted_text"


def test_blanks_at_the_ends_of_cells_are_kept(spark):
    from murmur.sources.io import write_csv
    path = os.path.join(tempfile.mkdtemp(prefix="murmur-test-"), "b")
    rows = [("1", " a , b "), ("2", '"q" '), ("3", ""), ("4", "x\n\ny ")]
    write_csv(spark.createDataFrame(rows, "id_str string, text string"), path)
    got = {r.id_str: r.text for r in read_messages(spark, path, ["id_str", "text"]).collect()}
    assert got == {"1": " a , b ", "2": '"q" ', "3": "", "4": "x  y "}


def test_topic_lists_come_back(spark):
    from murmur.sources.io import read_topic_lists, write_topic_lists
    path = os.path.join(tempfile.mkdtemp(prefix="murmur-test-"), "t")
    rows = [(0, "b", 0.25), (0, "a", 0.25), (0, "c", 0.5), (7, "é", 1e-7)]
    write_topic_lists(spark.createDataFrame(rows, "topic long, word string, weight double"), path)
    got = sorted(tuple(r) for r in read_topic_lists(spark, path).collect())
    assert got == [(0, 1, "c", 0.5), (0, 2, "a", 0.25), (0, 3, "b", 0.25), (7, 1, "é", 1e-7)]


def test_keywords_from_a_file_choose_messages(spark):
    from murmur.sources.io import write_matching
    base = os.path.join(tempfile.mkdtemp(prefix="murmur-test-"), "m")
    rows = [("1", "Vote, now!"), ("2", "voted"), ("3", None), ("4", "no vote")]
    path = write_matching(spark.createDataFrame(rows, "id_str string, text string"), ["vote"], base)
    assert path == base + "_political"
    assert {r.id_str for r in read_messages(spark, path, ["id_str", "text"]).collect()} == {"1", "4"}


def test_streams_read_a_table_of_one_file_or_of_many(spark, tmp_path):
    """``documents.parquet`` may be a file, or a folder of parts."""
    import shutil

    from __spark_entry__ import queries
    docs = spark.createDataFrame([(i, "say thatin now" if i % 2 else "other", "en", "web", 5) for i in range(10)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "part").glob("part-*.parquet")), tmp_path / "one" / "documents.parquet")
    for kind in ("many", "one"):
        sf = str(tmp_path / kind)
        assert queries()["stream_count"](spark, sf).first().n_messages == 10
        assert queries()["track_stream"](spark, sf).count() == 5
