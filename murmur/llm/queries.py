"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (adaptive_scan, fill_middle, grid_join, jaccard_tree, langid, packing, quality, sp_bpe, spelling, suffix_array, suffix_tree,
                        token_count, toxicity)
from murmur.llm.common import documents, on_workers
from murmur.session import table


def remainder():
    """crc32 of the id as text, modulo 5: the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def held_out():
    return F.coalesce(remainder() == 0, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = langid.train(docs.where(remainder() != 0))
    return langid.identify(docs, network).select("doc_id", held_out(), "lang_pred", "score")


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048, 1, with_ids=False)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.train(docs.where(remainder() != 0), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", held_out(), "score", "predicted")


def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.search(table(on_workers(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.join(documents(spark, sf_dir), 4, 85)


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_spans(documents(spark, sf_dir), 50)


OP2_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w),
hashed AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM starts),
keyed AS (
  SELECT doc_id, i, row_number() OVER p AS nth, first_value(doc_id) OVER p AS origin
  FROM hashed WINDOW p AS (PARTITION BY k ORDER BY doc_id, i)),
later AS (
  SELECT doc_id, i, origin, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM keyed WHERE nth > 1),
runs AS (
  SELECT doc_id, i, origin, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later)
SELECT doc_id, CAST(min(i) - 1 AS BIGINT) AS span_start, CAST(max(i) + 50 - min(i) AS BIGINT) AS span_words,
       arg_min(origin, i) AS earlier_doc_id
FROM runs GROUP BY doc_id, run
"""


def op9_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_duplicates(table(on_workers(spark), sf_dir, "embeddings"), 0.95)


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.dedup(documents(spark, sf_dir), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w),
keyed AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM starts),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM keyed WHERE nth > 1),
word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(documents(spark, sf_dir), 7, 100, 50)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(u) + 1) AS r2,
         CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 50 AS spm, text = '' OR regexp_matches(text, '<[PSM]>') AS plain FROM d),
c AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(u[greatest(r1, r2) + 1:], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), 7, 2, 10)


OP12_SQL = """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS g(b))),
w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
  FROM documents),
g AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM g),
crc AS (
  SELECT w, n, xor(4294967295, list_reduce(list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h
  FROM x, t),
f AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM crc),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (
  SELECT DISTINCT word, i, substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, k FROM cut WHERE k IN (SELECT word FROM v)
  UNION SELECT k, word FROM cut WHERE k IN (SELECT word FROM v)),
top AS (
  SELECT a, count(*) AS n_near, max(n) AS top_n, arg_min(b, (-n, b)) AS top FROM near JOIN v ON v.word = b GROUP BY a),
form AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM v LEFT JOIN top ON a = word),
chain(word, tip) AS (
  SELECT word, word FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.tip WHERE form.form IS NOT NULL)
SELECT form.word, form.form, tip AS root, form.n, CAST(form.n_near AS BIGINT) AS n_near, form.form_n
FROM form JOIN chain ON chain.word = form.word JOIN form last ON last.word = chain.tip AND last.form IS NULL
"""


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs.where(remainder() != 0), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(), "score", "predicted")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_array": op2_suffix_array,
    "op3_curve_packing": op3_curve_packing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_adaptive_scan": op6_adaptive_scan,
    "op7_jaccard_tree": op7_jaccard_tree,
    "op8_token_counts": op8_token_counts,
    "op9_grid_join": op9_grid_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality": op13_quality,
}
ORACLE: dict[str, str] = {
    "op2_suffix_array": OP2_SQL,
    "op7_jaccard_tree": OP7_SQL,
    "op9_grid_join": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
