"""Step 4: keyword filter, id-list labels, class counts, ranges, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions.text import clean_and_tokenize, normalize_format
from murmur.functions.wordlists import DEFAULT_STOPWORDS
from murmur.operators import relational as R
from murmur.operators import vocab as V
from murmur.functions.text import normalize_punctuation, split_words
from murmur.plans import sqltext as st
from murmur.plans import views
from murmur.plans.registry import query
from murmur.plans.sqlviews import LABELLED, TOKENS, with_
from murmur.session import table

# query parameters (our choice of words that occur in the corpus)
KEYWORDS = ["thatin", "anwhan", "stering", "ofrehalyon", "cióngañ"]
_KW = ", ".join(st.lit(k) for k in KEYWORDS)


@query("keyword_filter", with_(("toks", TOKENS))
       + f"SELECT doc_id FROM toks WHERE len(list_filter(tokens, lambda t: t IN ({_KW}))) > 0")
def keyword_filter(spark, sf):
    return R.keyword_filter(views.doc_tokens(spark, sf), KEYWORDS).select("doc_id")


@query("label_by_membership",
       "SELECT doc_id AS id_str, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) "
       "THEN 'T' ELSE 'F' END AS label FROM documents")
def label_by_membership(spark, sf):
    msgs = views.documents(spark, sf).select(F.col("doc_id").alias("id_str"))
    pos = table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return R.label_by_membership(msgs, pos, "id_str").select("id_str", "label")


@query("class_counts", with_(("labelled", LABELLED)) + "SELECT label, count(*) AS n FROM labelled GROUP BY label")
def class_counts(spark, sf):
    return R.class_counts(views.labelled(spark, sf), "label")


DATE_LO, DATE_HI = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


@query("date_range_filter",
       f"SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE ts BETWEEN TIMESTAMP '{DATE_LO}' AND TIMESTAMP '{DATE_HI}'")
def date_range_filter(spark, sf):
    ev = table(spark, sf, "events")
    out = R.date_range_filter(ev, "ts", DATE_LO, DATE_HI)
    from murmur.operators.timeline import micros
    return out.select("event_id", micros("ts", out).alias("ts_us"))


@query("latest_by_id_range",
       "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id DESC) - 1) // 100)::BIGINT AS page FROM ("
       "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'the') ORDER BY doc_id DESC LIMIT 10100)")
def latest_by_id_range(spark, sf):
    docs = views.documents(spark, sf)
    out = R.latest_by_id_range(docs, "doc_id", match=F.lower("text").rlike("the"))
    return out.select("doc_id", "page")


@query("stopword_anti",
       "SELECT doc_id, pos, token FROM (SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS token FROM "
       f"(SELECT doc_id, {st.split_words(st.norm_punct(st.norm_format('text')))} AS t FROM documents)) "
       f"WHERE token NOT IN ({', '.join(st.lit(w) for w in DEFAULT_STOPWORDS)})")
def stopword_anti(spark, sf):
    docs = views.documents(spark, sf)
    toks = docs.select("doc_id", split_words(normalize_punctuation(normalize_format("text"))).alias("t"))
    long = V.explode_positions(toks, "doc_id", "t")
    stop = spark.createDataFrame([(w,) for w in DEFAULT_STOPWORDS], "word string")
    return R.stopword_anti(long, stop).select("doc_id", "pos", "token")


@query("union_corpora",
       f"SELECT 'documents' AS corpus, doc_id::VARCHAR AS id_str, len({st.clean_tokens('text', DEFAULT_STOPWORDS)})::BIGINT AS n_tokens FROM documents "
       f"UNION ALL SELECT 'conversations', conv_id::VARCHAR || ':' || turn::VARCHAR, "
       f"len({st.clean_tokens('text', DEFAULT_STOPWORDS)})::BIGINT FROM conversations")
def union_corpora(spark, sf):
    docs = views.documents(spark, sf).select(F.col("doc_id").cast("string").alias("id_str"), "text")
    conv = table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id_str"), "text")
    u = R.union_corpora(("documents", docs), ("conversations", conv))
    return u.select("corpus", "id_str",
                    F.size(clean_and_tokenize(normalize_format("text"), DEFAULT_STOPWORDS)).cast("long").alias("n_tokens"))


@query("label_encode",
       "SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::BIGINT AS label_id FROM documents")
def label_encode(spark, sf):
    return R.label_encode(views.documents(spark, sf), "lang").select("doc_id", "lang", "label_id")
