"""Steps 1-2: text rules, vocabulary, bag of words, TF-IDF."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from murmur.functions.text import (normalize_format, normalize_punctuation, split_words,
                                   valid_tokens)
from murmur.functions.wordlists import DEFAULT_STOPWORDS
from murmur.operators import vocab as V
from murmur.plans import sqltext as st
from murmur.plans import views
from murmur.plans.registry import query
from murmur.plans.sqlviews import TEXT_CTES, TEXT_CTES_ALL, TFIDF, with_
from murmur.session import table

STOP = DEFAULT_STOPWORDS


@query("newline_normalize", f"SELECT doc_id, {st.norm_format('text')} AS text FROM documents")
def newline_normalize(spark, sf):
    return views.documents(spark, sf).select("doc_id", normalize_format("text").alias("text"))


@query("normalize_text",
       f"SELECT doc_id, {st.norm_punct(st.norm_format('text'))} AS norm_text FROM documents")
def normalize_text(spark, sf):
    docs = views.documents(spark, sf)
    return docs.select("doc_id", normalize_punctuation(normalize_format("text")).alias("norm_text"))


_TOK_SQL = ("SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS token FROM "
            "(SELECT doc_id, {expr} AS t FROM documents)")


@query("tokenize", _TOK_SQL.format(expr=st.split_words(st.norm_punct(st.norm_format("text")))))
def tokenize(spark, sf):
    docs = views.documents(spark, sf)
    toks = docs.select("doc_id", split_words(normalize_punctuation(normalize_format("text"))).alias("t"))
    return V.explode_positions(toks, "doc_id", "t")


@query("clean_tokens", _TOK_SQL.format(expr=st.clean_tokens("text", STOP)))
def clean_tokens(spark, sf):
    toks = views.doc_tokens(spark, sf, STOP)
    return V.tokens_long(toks)


_URL_TEXT = "concat('RT @', page_id, 'x: see ', url, '. ok #t', page_id, ' @', url)"


@query("url_user_tags",
       f"SELECT page_id, {st.norm_punct(_URL_TEXT, rt=True)} AS norm_text, "
       f"array_to_string({st.valid(st.split_words(st.norm_punct(_URL_TEXT, rt=True)), [])}, '|') AS t "
       "FROM pages")
def url_user_tags(spark, sf):
    pages = table(spark, sf, "pages")
    text = F.expr(_URL_TEXT)
    norm = normalize_punctuation(text, rt=True)
    return pages.select("page_id", norm.alias("norm_text"), valid_tokens(split_words(norm), []).alias("t")) \
        .select("page_id", "norm_text", F.array_join("t", "|").alias("t"))


@query("vocab_df", with_(*TEXT_CTES[:3]) + "SELECT token, df, cf FROM vocab")
def vocab_df(spark, sf):
    bow = V.bag_of_words(views.doc_tokens(spark, sf, STOP))
    return V.vocabulary(bow).select("token", "df", "cf")


def _kept(spark, sf, keep_n=None):
    docs = views.doc_tokens(spark, sf, STOP)
    # the bag feeds the vocabulary, the TF-IDF join and the norms: keep it
    bow = V.bag_of_words(docs).persist(StorageLevel.MEMORY_AND_DISK)
    kept = V.filter_extremes(V.vocabulary(bow), V.count_docs(docs), views.BOW_NO_BELOW,
                             views.BOW_NO_ABOVE, keep_n)
    return docs, bow, kept


@query("vocab_filter_extremes", with_(*TEXT_CTES) + "SELECT token, token_id, df FROM kept")
def vocab_filter_extremes(spark, sf):
    return _kept(spark, sf, views.BOW_KEEP_N)[2].select("token", "token_id", "df")


@query("doc2bow", with_(*TEXT_CTES_ALL) + "SELECT b.doc_id, k.token_id, b.tf FROM bow b JOIN kept k USING (token)")
def doc2bow(spark, sf):
    _, bow, kept = _kept(spark, sf)
    return V.doc2bow(bow, kept).select("doc_id", "token_id", "tf")


@query("tfidf", with_(*TEXT_CTES_ALL, ("tfidf", TFIDF))
       + "SELECT doc_id, token_id, round(weight, 6) AS weight FROM tfidf WHERE abs(weight) > 1e-12")
def tfidf(spark, sf):
    docs, bow, kept = _kept(spark, sf)
    w = V.tfidf(bow, kept, V.count_docs(docs))
    return w.select("doc_id", "token_id", F.round("weight", 6).alias("weight"))


def tfidf_top_terms_df(spark, sf, k=5):
    docs, bow, kept = _kept(spark, sf)
    w = V.tfidf(bow, kept, V.count_docs(docs))
    top = V.top_terms(w, k)
    return top.select("doc_id", F.col("rank").cast("long").alias("rank"), "token",
                      F.round("weight", 6).alias("weight"))


@query("tfidf_top_terms", with_(*TEXT_CTES_ALL, ("tfidf", TFIDF))
       + "SELECT doc_id, rank, token, round(weight, 6) AS weight FROM ("
         "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token)::BIGINT AS rank "
         "FROM tfidf WHERE abs(weight) > 1e-12) WHERE rank <= 5")
def tfidf_top_terms(spark, sf):
    return tfidf_top_terms_df(spark, sf, 5)
