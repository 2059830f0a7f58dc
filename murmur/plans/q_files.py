"""Composed files (written, read back), probe words, reports and labels."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from murmur.functions.text import clean_and_tokenize, normalize_format
from murmur.functions.wordlists import DEFAULT_STOPWORDS
from murmur.operators import models as ML
from murmur.operators import phrases as P
from murmur.operators import relational as R
from murmur.operators import sampling as S
from murmur.operators import timeline as TL
from murmur.operators import topics as TP
from murmur.operators import vectors as VX
from murmur.operators import vocab as V
from murmur.plans import q_topics, views
from murmur.plans import sqltext as st
from murmur.plans.q_phrases import MIN_COUNT, sql_phrases
from murmur.plans.q_relational import KEYWORDS
from murmur.plans.q_vectors import _STD_SQL, _U, TOPN, _cos_terms
from murmur.plans.registry import query
from murmur.plans.sqlviews import BOW, TOKENS, VOCAB, with_
from murmur.session import scratch_path, spread, table
from murmur.sources import io as IO


def _place(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}/documents.csv")


def _messages(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id_str"), normalize_format("text").alias("text"), "lang")


@query("cleaned_file", f"SELECT doc_id::VARCHAR AS id_str, {st.norm_format('text')} AS text, {st.norm_punct(st.norm_format('text'))} AS normalized FROM documents")
def cleaned_file(spark, sf):
    """The cleaned file of the messages, with the normalised text, read back."""
    path = IO.write_cleaned(_messages(spark, sf), _place(spark, "cleaned"), ["id_str", "text"], by="id_str")
    return IO.read_messages(spark, path, ["id_str", "text", "normalized"])


_KW = ", ".join(st.lit(k) for k in KEYWORDS)


@query("keyword_file", f"""SELECT doc_id::VARCHAR AS id_str, {st.norm_format('text')} AS text FROM documents
WHERE len(list_filter({st.split_words(st.norm_punct(st.norm_format('text')))}, lambda t: t IN ({_KW}))) > 0""")
def keyword_file(spark, sf):
    """Messages that match a keyword list read from a file, as a file."""
    base = _place(spark, "keywords").removesuffix(".csv")
    spark.createDataFrame([(f" {k} ",) for k in ["", *KEYWORDS]], "value string").write.text(f"{base}_words")
    words = [r.word for r in IO.read_word_list(spark, f"{base}_words").collect()]  # a keyword list
    path = IO.write_matching(_messages(spark, sf).drop("lang"), words, base)
    return IO.read_messages(spark, path, ["id_str", "text"])


@query("labelled_file", f"""SELECT doc_id::VARCHAR AS id_str, {st.norm_format('text')} AS text,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'T' ELSE 'F' END AS label FROM documents""")
def labelled_file(spark, sf):
    """Messages labelled by an id list, as the labelled file, read back."""
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string"))
    path = _place(spark, "labelled")
    IO.write_csv(IO.labelled_for_output(R.label_by_membership(_messages(spark, sf), ids)), path)
    return IO.read_messages(spark, path, ["id_str", "text", "label"])


@query("json_roundtrip", "SELECT doc_id, text, lang FROM documents")
def json_roundtrip(spark, sf):
    path = _place(spark, "json")
    IO.write_json(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id long, text string, lang string").json(path)


@query("json_file", "SELECT n_nationkey, n_name FROM nation")
def json_file(spark, sf):
    """A file that is one JSON array."""
    path = _place(spark, "json")
    rows = table(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")), {"pretty": "true"}).alias("value"))
    rows.coalesce(1).write.text(path)
    return IO.read_json_file(spark, path).select(F.col("n_nationkey").cast(table(spark, sf, "nation").schema["n_nationkey"].dataType), "n_name")


@query("materialized", "SELECT doc_id, n_chars FROM documents")
def materialized(spark, sf):
    """A table that is written once: another one under its name is not."""
    path, docs = _place(spark, "materialized"), table(spark, sf, "documents").select("doc_id", "n_chars")
    IO.materialize(docs, path)
    return IO.materialize(docs.select("doc_id", (F.col("n_chars") * 0).alias("n_chars")), path)


@query("shuffled_order", "SELECT doc_id, md5('3:' || doc_id) AS \"_order\" FROM documents")
def shuffled_order(spark, sf):
    return S.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 3)


@query("libsvm_file", _STD_SQL + "SELECT (CASE WHEN label >= 5 THEN 1 ELSE -1 END)::DOUBLE AS label, dim, round(sum(z), 6) AS z FROM z GROUP BY ALL")
def libsvm_file(spark, sf):
    """Scaled features as a file for an external learner, read back and summed
    by label and column."""
    emb = table(spark, sf, "embeddings").select(F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    z = VX.Standardizer.fit(emb, "v").transform(emb, "v", "z")
    path = _place(spark, "libsvm")
    IO.write_libsvm(z.select(F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"), array_to_vector("z").alias("features")), path)
    back = spark.read.format("libsvm").load(path).select("label", vector_to_array("features").alias("z"))
    cells = back.select("label", F.posexplode("z").alias("dim", "z"))
    return cells.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.sum("z"), 6).alias("z"))


@query("text_corpus", "SELECT count(*) AS n_lines, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY doc_id % 64")
def text_corpus(spark, sf):
    """A corpus of text files, one document a file, chosen by the start of their
    names: here the documents' ids, dealt to files."""
    base = _place(spark, "corpus").removesuffix(".csv")
    ids = table(spark, sf, "documents").select((F.col("doc_id") % 64).alias("part"), F.col("doc_id").cast("string").alias("value"))
    ids.repartition("part").write.partitionBy("part").text(base)
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    texts = IO.read_text_corpus(spark, base, "part-").select(lines.alias("lines"))
    return texts.select(F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("ids"))


# ---- probe words ------------------------------------------------------------------

_PROBES = [(["w1", "w2"], ["w3"]), (["w10"], []), (["w5", "unknown"], ["w7", "w8"])]


def _probe_sql(line: int, pos: list[str], neg: list[str]) -> str:
    pos, neg = [w for w in pos if w != "unknown"], [w for w in neg if w != "unknown"]
    num = "1.0" + (" * " + _cos_terms(pos, "p") if pos else "")
    den = "1.0" + (" * " + _cos_terms(neg, "n") if neg else "")
    tables = [f"(SELECT u FROM u WHERE word = {st.lit(w)}) {a}{i}" for a, ws in (("p", pos), ("n", neg)) for i, w in enumerate(ws)]
    return (f"SELECT {line}::BIGINT AS line, (row_number() OVER (ORDER BY score DESC, word))::BIGINT AS rank, word, score FROM (SELECT u.word, ({num}) / ({den} + 0.000001) AS score "
            f"FROM u, {', '.join(tables)} WHERE u.word NOT IN ({', '.join(st.lit(w) for w in pos + neg)}))")


@query("probe_words", "WITH " + _U + "a AS (" + " UNION ALL ".join(_probe_sql(i, *p) for i, p in enumerate(_PROBES))
       + f") SELECT line, rank, word, round(score, 6) AS score FROM a WHERE rank <= {TOPN}")
def probe_words(spark, sf):
    """Analogies of a file of probe words (``positive : negative`` a line)."""
    path = _place(spark, "probes")
    lines = [(f"{' '.join(p)} : {' '.join(n)}",) for p, n in _PROBES]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    out = None
    for line, r in enumerate(IO.read_probe_words(spark, path).orderBy("line").collect()):  # the lines of a probe file
        one = VX.cosmul(views.word_vectors(spark, sf), r.positive, r.negative, TOPN)
        one = one.select(F.lit(line).cast("long").alias("line"), "rank", "word", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- phrases, clusters, topics --------------------------------------------------------

_THRESHOLDS = (6000, 7000, 8000, 10000)


@query("bigram_thresholds", with_(("toks", TOKENS), *sql_phrases("toks", "bg", MIN_COUNT, _THRESHOLDS[0])[:5])
       + "SELECT threshold, a, b, round(score, 6) AS score FROM bg_phr, (SELECT unnest([" + ", ".join(map(str, _THRESHOLDS)) + "]) AS threshold) WHERE score > threshold")
def bigram_thresholds(spark, sf):
    """The phrases over each of four thresholds; pairs are scored once."""
    scores = P.phrase_scores(views.doc_tokens(spark, sf), MIN_COUNT, _THRESHOLDS[0])
    rows = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, _THRESHOLDS)))).where("score > threshold")
    return rows.select("threshold", "a", "b", F.round("score", 6).alias("score"))


@query("cluster_report", """WITH wv AS (SELECT 'w' || vec_id AS word, label, embedding::DOUBLE[] AS v FROM embeddings),
cd AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS d, unnest(v) AS x FROM wv) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY d) AS c FROM cd GROUP BY label),
cn AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c),
u AS (SELECT word, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM wv),
sc AS (SELECT cn.label, u.word, row_number() OVER (PARTITION BY cn.label ORDER BY list_dot_product(u.u, cn.c) DESC, u.word) AS r FROM cn, u),
n AS (SELECT label, count(*) AS size FROM wv GROUP BY label)
SELECT label AS cluster, any_value(size) AS size, string_agg(word, ' ' ORDER BY r) AS words FROM sc JOIN n USING (label) WHERE r <= 20 GROUP BY label""")
def cluster_report(spark, sf):
    """Size and the twenty words nearest the centre of each cluster."""
    emb = views.word_vectors(spark, sf).join(table(spark, sf, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "label"), "word")
    top = VX.nearest_to_vectors(emb.select("word", "vector"), VX.group_centres(emb, "label"), 20)
    words = top.groupBy(F.col("query").cast("int").alias("label")).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    sizes = emb.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(words, "label").select(F.col("label").alias("cluster"), "size", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("words"))


@query("first_words", with_(("toks", TOKENS), ("bow", BOW), ("vocab", VOCAB)) + """SELECT cluster, rank, word FROM (
  SELECT length(token)::INT AS cluster, token AS word, row_number() OVER (PARTITION BY length(token) ORDER BY df DESC, token) AS rank FROM vocab) WHERE rank <= 10""")
def first_words(spark, sf):
    """The ten words in most messages of each group of words of one length."""
    vocab = V.vocabulary(V.bag_of_words(views.doc_tokens(spark, sf)))
    return TP.first_words(vocab.select(F.length("token").alias("cluster"), F.col("token").alias("word"), "df"))


@query("topic_label_lists", q_topics.SQL + """SELECT topic, string_agg(word, ' ' ORDER BY word) AS by_word, string_agg(word, ' ' ORDER BY weight DESC, word) AS by_weight FROM tw GROUP BY topic""")
def topic_label_lists(spark, sf):
    """Topic labels, alphabetical and heaviest first."""
    tw = q_topics._tw(spark, sf)
    return ML.topic_labels(tw).withColumnRenamed("label", "by_word").join(ML.topic_labels(tw, "weight").withColumnRenamed("label", "by_weight"), "topic")


@query("topic_artifacts", q_topics.SQL + """, d AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank, word, weight FROM tw),
lab AS (SELECT topic, string_agg(word, ' ' ORDER BY word) AS label FROM tw GROUP BY topic),
hh AS (SELECT topic, count(*) AS n_bins, sum(weight) AS messages FROM hist GROUP BY topic)
SELECT topic, rank, word, round(weight, 6) AS weight, label, n_bins, messages FROM d JOIN lab USING (topic) JOIN hh USING (topic)""")
def topic_artifacts(spark, sf):
    """Definitions (also as text lists), histogram and labels of the topics,
    written and read back together."""
    base, tw = _place(spark, "topics").removesuffix(".csv"), q_topics._tw(spark, sf)
    IO.write_topic_lists(tw, f"{base}/lists")
    defs = IO.read_topic_lists(spark, f"{base}/lists")
    dated = q_topics._doc_topics(spark, sf).withColumn("ts", F.timestamp_micros(F.lit(q_topics.T2024_US) + F.col("doc_id") * 60_000_000))
    hist = TL.topic_histogram(TL.with_lagged_bins(dated, "ts", "doc_id").withColumn("weight", F.lit(1.0)))
    IO.write_topic_artifacts(base, defs, hist, ML.topic_labels(tw))
    back = IO.read_topic_artifacts(spark, base)
    bins = back["histogram"].groupBy("topic").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("weight").alias("messages"))
    return (back["definitions"].join(back["labels"], "topic").join(bins, "topic")
            .select("topic", "rank", "word", F.round("weight", 6).alias("weight"), "label", "n_bins", "messages"))


@query("train_and_test", f"""WITH a AS (SELECT 'train' AS split, doc_id AS id, {st.clean_tokens('text', DEFAULT_STOPWORDS)} AS tokens FROM documents
  UNION ALL SELECT 'test', item_id, {st.clean_tokens('text', DEFAULT_STOPWORDS)} FROM benchmark),
t AS (SELECT split, id, unnest(tokens) AS token FROM a),
v AS (SELECT token FROM (SELECT DISTINCT * FROM t) GROUP BY token HAVING count(*) >= 2)
SELECT split, id, count(*) AS n_known, count(DISTINCT token) AS n_words FROM t JOIN v USING (token) GROUP BY ALL""")
def train_and_test(spark, sf):
    """A test corpus under a training corpus: one vocabulary, then told apart."""
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text")
    both = R.train_and_test(docs, table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))
    rows = both.select(F.struct("split", "id").alias("doc_id"), clean_and_tokenize(normalize_format("text"), DEFAULT_STOPWORDS).alias("tokens"))
    # the rules run and words are counted once: the vocabulary and the counts both read the bags
    bow = V.bag_of_words(rows).persist(StorageLevel.MEMORY_AND_DISK)
    known = V.doc2bow(bow, V.filter_extremes(V.vocabulary(bow), V.count_docs(rows), 2, 1.0))
    return known.groupBy("doc_id").agg(F.sum("tf").alias("n_known"), F.count(F.lit(1)).alias("n_words")).select("doc_id.split", "doc_id.id", "n_known", "n_words")


# a topic word takes the vector that a hash of it names
_WORD_VEC = "CAST('0x' || substr(md5(word), 1, 8) AS UBIGINT) % (SELECT count(*) FROM embeddings)"


@query("topic_centroids", q_topics.SQL + f""", ev AS (SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
tv AS (SELECT topic, {_WORD_VEC} AS vec_id FROM tw)
SELECT topic, dim, round(sum(x), 5) AS value FROM tv JOIN ev ON ev.vec_id = tv.vec_id GROUP BY ALL""")
def topic_centroids(spark, sf):
    """The sum of the vectors of each topic's words."""
    emb, tw = table(spark, sf, "embeddings"), q_topics._tw(spark, sf)
    n = emb.select(F.count(F.lit(1))).scalar()
    named = tw.select("word").distinct().withColumn("vec_id", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % n)
    vectors = named.join(emb.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id")
    return TP.topic_vectors(tw, vectors).withColumn("value", F.round("value", 5))


@query("topic_map")
def topic_map(spark, sf):
    """The topics' vectors in two dimensions."""
    rows = topic_centroids(spark, sf).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_p"))
    return ML.pca_2d(rows.select("topic", F.transform("_p", lambda x: x["value"]).alias("vector")), "vector")
