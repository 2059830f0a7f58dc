"""DuckDB twins of :mod:`murmur.plans.views` (CTE bodies)."""

from __future__ import annotations

from murmur.functions.wordlists import DEFAULT_STOPWORDS
from murmur.plans import sqltext as st

TOKENS = f"SELECT doc_id, {st.clean_tokens('text', DEFAULT_STOPWORDS)} AS tokens FROM documents"
BOW = ("SELECT doc_id, token, count(*)::BIGINT AS tf FROM "
       "(SELECT doc_id, unnest(tokens) AS token FROM toks) GROUP BY doc_id, token")
VOCAB = ("SELECT token, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, min(doc_id) AS first_doc "
         "FROM bow GROUP BY token")
KEPT = ("SELECT *, (row_number() OVER (ORDER BY first_doc, token) - 1)::BIGINT AS token_id FROM ("
        "SELECT * FROM vocab WHERE df >= 2 AND df <= floor(0.9 * (SELECT count(*) FROM documents)) "
        "ORDER BY df DESC, token LIMIT 100000)")
# the same bounds without a limit on the number of terms
KEPT_ALL = ("SELECT *, (row_number() OVER (ORDER BY first_doc, token) - 1)::BIGINT AS token_id FROM vocab "
            "WHERE df >= 2 AND df <= floor(0.9 * (SELECT count(*) FROM documents))")
TFIDF = ("SELECT doc_id, token_id, token, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight "
         "FROM (SELECT b.doc_id, k.token_id, b.token, b.tf, "
         "b.tf * log2((SELECT count(*) FROM documents) / k.df) AS w "
         "FROM bow b JOIN kept k USING (token)) WHERE w <> 0")
LABELLED = ("SELECT d.*, l.quality AS label FROM documents d JOIN labels l USING (doc_id)")
PREDICTIONS = ("SELECT *, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS prediction, "
               "n_chars::DOUBLE AS score FROM labelled")
WORD_VECTORS = "SELECT 'w' || vec_id AS word, embedding::DOUBLE[] AS vector FROM embeddings"
TOKEN_VECTORS = "SELECT vec_id // 10 AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS vector FROM embeddings"


def with_(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in ctes) + "\n"


TEXT_CTES = [("toks", TOKENS), ("bow", BOW), ("vocab", VOCAB), ("kept", KEPT)]
TEXT_CTES_ALL = [*TEXT_CTES[:3], ("kept", KEPT_ALL)]
