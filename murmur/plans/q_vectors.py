"""Step 8: scaling, message vectors, similarity search, vector text rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions.text import word_to_identifier
from murmur.operators import vectors as VX
from murmur.operators.topk import top_k_per_group
from murmur.plans import views
from murmur.plans.registry import query
from murmur.plans.sqltext import lit
from murmur.session import table

# probe word sets (parameters; the words are rows of the embeddings table)
PROBES = [["w1", "w2"], ["w10"], ["w100", "w200", "w300"]]
COSMUL_POS, COSMUL_NEG = ["w1", "w2"], ["w3"]
TOPN = 10


def _r(c, name=None):
    return F.round(c, 6).alias(name or c)


_STD_SQL = """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding)))::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY dim),
z AS (SELECT vec_id, label, dim, (x - m) / CASE WHEN sd = 0 OR sd IS NULL THEN 1 ELSE sd END AS z FROM e JOIN s USING (dim))
"""


@query("standardize", _STD_SQL + "SELECT vec_id, dim, round(z, 6) AS z FROM z")
def standardize(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    z = VX.Standardizer.fit(emb, "v").transform(emb, "v", "z")
    return z.select("vec_id", F.posexplode("z").alias("dim", "z")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), _r("z"))


_TV = ("tv AS (SELECT vec_id // 10 AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings), "
       "m AS (SELECT doc_id, list(v ORDER BY pos) AS vs, count(*) AS n FROM tv GROUP BY doc_id), ")


def _blocks(spark, sf, d0, d1):
    tv = views.token_vectors(spark, sf)
    return VX.message_vector_blocks(tv, d0=d0, d1=d1).select("doc_id", "block", "dim", _r("value"))


@query("doc_vec_median_std", "WITH " + _TV + """base AS (SELECT doc_id, unnest(range(len(v)))::BIGINT AS dim, unnest(v) AS x FROM tv)
SELECT doc_id, '00_avg' AS block, dim, round(median(x), 6) AS value FROM base GROUP BY doc_id, dim
UNION ALL SELECT doc_id, '01_std', dim, round(stddev_pop(x), 6) FROM base GROUP BY doc_id, dim""")
def doc_vec_median_std(spark, sf):
    return _blocks(spark, sf, 1, 1)


@query("doc_vec_diff1", "WITH " + _TV + """d AS (SELECT doc_id, s.i, unnest(range(len(v)))::BIGINT AS dim,
  unnest(list_transform(v, lambda x, j: x - v[((j - 1 - s.i) % len(v) + len(v)) % len(v) + 1])) AS x
  FROM tv, (SELECT unnest(range(1, 5)) AS i) s)
SELECT doc_id, printf('%02d_diff1_%d', 2 * i, i) AS block, dim, round(median(x), 6) AS value FROM d GROUP BY doc_id, i, dim
UNION ALL SELECT doc_id, printf('%02d_diff1_std_%d', 2 * i + 1, i), dim, round(stddev_pop(x), 6) FROM d GROUP BY doc_id, i, dim""")
def doc_vec_diff1(spark, sf):
    return _blocks(spark, sf, 1, 5).filter(F.col("block").contains("diff1"))


@query("doc_vec_diff0", "WITH " + _TV + """r AS (SELECT doc_id, s.i, n, vs, unnest(range(n - 1)) AS t FROM m, (SELECT unnest(range(1, 6)) AS i) s WHERE n > s.i),
d AS (SELECT doc_id, i, unnest(range(len(vs[1])))::BIGINT AS dim,
  unnest(list_transform(range(len(vs[1])), lambda k: (vs[t + 2][k + 1] - vs[((t + 1 - i) % n + n) % n + 1][k + 1])
                                                    - (vs[t + 1][k + 1] - vs[((t - i) % n + n) % n + 1][k + 1]))) AS x FROM r),
z AS (SELECT doc_id, s.i, unnest(range(len(vs[1])))::BIGINT AS dim FROM m, (SELECT unnest(range(1, 6)) AS i) s WHERE n <= s.i)
SELECT doc_id, printf('%02d_diff0_std_%d', i + 1, i) AS block, dim, round(stddev_pop(x), 6) AS value FROM d GROUP BY doc_id, i, dim
UNION ALL SELECT doc_id, printf('%02d_diff0_std_%d', i + 1, i), dim, 0.0 FROM z""")
def doc_vec_diff0(spark, sf):
    return _blocks(spark, sf, 6, 1).filter(F.col("block").contains("diff0"))


_U = ("wv AS (SELECT 'w' || vec_id AS word, embedding::DOUBLE[] AS v FROM embeddings), "
      "u AS (SELECT word, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM wv), ")
_PW = ", ".join(f"({i}, {lit(w)})" for i, p in enumerate(PROBES) for w in p)


@query("nearest_words", "WITH " + _U + f"""pw AS (SELECT * FROM (VALUES {_PW}) t(probe, word)),
qd AS (SELECT probe, d, avg(x) AS x FROM (SELECT probe, unnest(range(len(u))) AS d, unnest(u) AS x FROM pw JOIN u USING (word)) GROUP BY probe, d),
q AS (SELECT probe, list(x ORDER BY d) AS q FROM qd GROUP BY probe),
qn AS (SELECT probe, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM q),
sc AS (SELECT qn.probe, u.word, list_dot_product(u.u, qn.q) AS sim FROM qn, u
       WHERE NOT EXISTS (SELECT 1 FROM pw WHERE pw.probe = qn.probe AND pw.word = u.word))
SELECT probe, rank, word, round(sim, 6) AS sim FROM (
  SELECT *, (row_number() OVER (PARTITION BY probe ORDER BY sim DESC, word))::BIGINT AS rank FROM sc) WHERE rank <= {TOPN}""")
def nearest_words(spark, sf):
    nw = VX.nearest_words(views.word_vectors(spark, sf), PROBES, TOPN)
    return nw.select("probe", "rank", "word", _r("sim"))


def _cos_terms(words, alias):
    return " * ".join(f"((1 + list_dot_product(u.u, {alias}{i}.u)) / 2)" for i, _ in enumerate(words))


@query("cosmul", "WITH " + _U + "sc AS (SELECT u.word, (1.0 * " + _cos_terms(COSMUL_POS, "p") + ") / (1.0 * "
       + _cos_terms(COSMUL_NEG, "n") + " + 0.000001) AS score FROM u, "
       + ", ".join([f"(SELECT u FROM u WHERE word = {lit(w)}) p{i}" for i, w in enumerate(COSMUL_POS)]
                   + [f"(SELECT u FROM u WHERE word = {lit(w)}) n{i}" for i, w in enumerate(COSMUL_NEG)])
       + f" WHERE u.word NOT IN ({', '.join(lit(w) for w in COSMUL_POS + COSMUL_NEG)})) "
       f"SELECT rank, word, round(score, 6) AS score FROM (SELECT *, (row_number() OVER (ORDER BY score DESC, word))::BIGINT AS rank FROM sc) WHERE rank <= {TOPN}")
def cosmul(spark, sf):
    c = VX.cosmul(views.word_vectors(spark, sf), COSMUL_POS, COSMUL_NEG, TOPN)
    return c.select("rank", "word", _r("score"))


@query("augment_text", "WITH " + _U + f"""tw AS (SELECT vec_id // 10 AS doc_id, 'w' || vec_id AS word FROM embeddings),
dq AS (SELECT doc_id, d, avg(x) AS x FROM (SELECT doc_id, unnest(range(len(u))) AS d, unnest(u) AS x FROM tw JOIN u USING (word)) GROUP BY doc_id, d),
q AS (SELECT doc_id, list(x ORDER BY d) AS q FROM dq GROUP BY doc_id),
qn AS (SELECT doc_id, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM q),
sc AS (SELECT qn.doc_id, u.word, list_dot_product(u.u, qn.q) AS sim FROM qn, u
       WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.doc_id = qn.doc_id AND tw.word = u.word))
SELECT doc_id, rank, regexp_replace(word, '[^A-Za-z0-9_]', '_', 'g') AS word, round(sim, 6) AS sim FROM (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, word))::BIGINT AS rank FROM sc) WHERE rank <= {TOPN}""")
def augment_text(spark, sf):
    emb = table(spark, sf, "embeddings")
    tw = emb.select(F.expr("vec_id div 10").alias("doc_id"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"))
    a = VX.augment_with_neighbours(tw, views.word_vectors(spark, sf), TOPN)
    return a.select("doc_id", "rank", word_to_identifier("word").alias("word"), _r("sim"))


@query("liblinear_rows", _STD_SQL + """, zl AS (SELECT vec_id, any_value(label) AS label, list(z ORDER BY dim) AS z FROM z GROUP BY vec_id)
SELECT vec_id, (CASE WHEN label >= 5 THEN '1' ELSE '-1' END) || ' ' || array_to_string(list_transform(z, lambda x, i: printf('%d:%f', i, x)), ' ') AS line FROM zl""")
def liblinear_rows(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    z = VX.Standardizer.fit(emb, "v").transform(emb, "v", "z")
    y = F.when(F.col("label") >= 5, 1).otherwise(0)
    return z.select("vec_id", VX.libsvm_line(y, F.col("z")).alias("line"))


@query("word_vec_rows", "SELECT 'w' || vec_id AS word, 'w' || vec_id || ',' || array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%.8f', x)), ',') AS line FROM embeddings")
def word_vec_rows(spark, sf):
    wv = views.word_vectors(spark, sf)
    return wv.select("word", VX.word_vector_line(F.col("word"), F.col("vector")).alias("line"))


@query("cluster_info_rows", """WITH w AS (SELECT label, 'w' || vec_id AS word FROM embeddings),
s AS (SELECT label, count(*) AS size FROM w GROUP BY label),
f AS (SELECT label, string_agg(word || ' ', '' ORDER BY word) AS words FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY word) AS r FROM w) WHERE r <= 10 GROUP BY label)
SELECT label AS cluster, printf('%2d, %5d,   : %s', label, size, words) AS line FROM s JOIN f USING (label)""")
def cluster_info_rows(spark, sf):
    emb = table(spark, sf, "embeddings")
    w = emb.select("label", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"))
    size = w.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    first = top_k_per_group(w, ["label"], [F.col("word")], 10, salt_cols=["word"])
    words = first.groupBy("label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("word")), lambda x: F.concat(x, F.lit(" "))), "").alias("words"))
    out = size.join(words, "label")
    return out.select(F.col("label").alias("cluster"),
                      F.format_string("%2d, %5d,   : %s", "label", "size", "words").alias("line"))


_BLOCKS_RAW = "WITH " + _TV + """base AS (SELECT doc_id, unnest(range(len(v)))::BIGINT AS dim, unnest(v) AS x FROM tv),
d AS (SELECT doc_id, s.i, unnest(range(len(v)))::BIGINT AS dim,
  unnest(list_transform(v, lambda x, j: x - v[((j - 1 - s.i) % len(v) + len(v)) % len(v) + 1])) AS x
  FROM tv, (SELECT unnest(range(1, 5)) AS i) s),
blocks AS (SELECT doc_id, '00_avg' AS block, dim, median(x) AS value FROM base GROUP BY doc_id, dim
  UNION ALL SELECT doc_id, '01_std', dim, stddev_pop(x) FROM base GROUP BY doc_id, dim
  UNION ALL SELECT doc_id, printf('%02d_diff1_%d', 2 * i, i), dim, median(x) FROM d GROUP BY doc_id, i, dim
  UNION ALL SELECT doc_id, printf('%02d_diff1_std_%d', 2 * i + 1, i), dim, stddev_pop(x) FROM d GROUP BY doc_id, i, dim),
per AS (SELECT doc_id, substr(block, 1, 2)::INT AS o, count(*) AS k, sum(value * value) AS ss FROM blocks GROUP BY ALL),
names AS (SELECT DISTINCT block AS feature_set, substr(block, 1, 2)::INT AS so FROM blocks)
"""


@query("nested_feature_sets", _BLOCKS_RAW + "SELECT doc_id, feature_set, sum(k)::BIGINT AS n_features, "
       "round(sqrt(sum(ss)), 6) AS l2 FROM per JOIN names ON o <= so GROUP BY doc_id, feature_set")
def nested_feature_sets(spark, sf):
    tv = views.token_vectors(spark, sf)
    blocks = VX.message_vector_blocks(tv, d0=1, d1=5)
    sets = VX.nested_feature_sets(blocks)
    return sets.select("doc_id", "feature_set", "n_features", _r("l2"))


@query("cluster_center_words", """WITH wv AS (SELECT 'w' || vec_id AS word, label, embedding::DOUBLE[] AS v FROM embeddings),
cd AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS d, unnest(v) AS x FROM wv) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY d) AS c FROM cd GROUP BY label),
cn AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c),
u AS (SELECT word, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM wv),
sc AS (SELECT cn.label AS cluster, u.word, list_dot_product(u.u, cn.c) AS sim FROM cn, u)
SELECT cluster, rank, word, round(sim, 6) AS sim FROM (
  SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, word))::BIGINT AS rank FROM sc) WHERE rank <= 20""")
def cluster_center_words(spark, sf):
    emb = table(spark, sf, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "label",
        F.col("embedding").cast("array<double>").alias("vector"))
    centres = VX.group_centres(emb, "label")
    top = VX.nearest_to_vectors(emb.select("word", "vector"), centres, 20)
    return top.select(F.col("query").cast("int").alias("cluster"), "rank", "word", _r("sim"))
