"""Topic definitions, topic similarity, threshold grouping and merging.

Threshold grouping reproduces the reference's order-dependent scan (topics
in ascending order; an unassigned topic opens a group; every neighbour is
*overwritten* with the current topic's group), which is not connected
components.  Closed form used here::

    parent(i) = max{k < i : k ~ i}        root(i) = end of the parent chain
    group(j)  = root(max neighbour of j)  (j itself when it has none)

``root`` is found by pointer jumping: each round is one join and halves the
remaining chain length, so the number of rounds is logarithmic in the depth.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.topk import top_k_per_group

TOPIC_WORDS = 20


def topic_words(rows: DataFrame, topic_col: str = "topic", word_col: str = "token",
                n: int = TOPIC_WORDS, count_col: str | None = None) -> DataFrame:
    """``(topic, word, weight)``: the ``n`` most frequent words of each topic,
    weight = count / total count of those ``n`` words.  ``rows`` are single
    occurrences, or pre-counted ones when ``count_col`` is given (e.g. a bag
    of words).  Counting is a partial aggregate and the top-n is salted, so a
    dominant topic is no hot spot."""
    cnt = F.sum(count_col) if count_col else F.count(F.lit(1))
    counts = rows.groupBy(topic_col, word_col).agg(cnt.alias("cnt"))
    top = top_k_per_group(counts, [topic_col], [F.col("cnt").desc(), F.col(word_col)], n,
                          salt_cols=[word_col])
    # the few words of a topic are together already: their total needs no second pass
    tot = F.sum("cnt").over(Window.partitionBy(topic_col))
    return (top.withColumn("_tot", tot).where(F.col(topic_col).isNotNull())
            .select(F.col(topic_col).alias("topic"), F.col(word_col).alias("word"),
                    (F.col("cnt") / F.col("_tot")).alias("weight")))


def topic_similarity(tw: DataFrame, eps: float = 1e-12) -> DataFrame:
    """``(ti, tj, sim)``, ``ti != tj``: cosine of the topics' TF-IDF vectors
    (term weight = topic weight x log2(topics / topics with the word),
    L2-normalised).  Pairs sharing no word are absent (similarity 0)."""
    n = tw.select(F.countDistinct("topic")).scalar()
    df = tw.groupBy("word").agg(F.countDistinct("topic").alias("_df"))
    w = (tw.join(df, "word").withColumn("_w", F.col("weight") * F.log2(n / F.col("_df")))
         .filter(F.col("_w") != 0))
    norm = w.groupBy("topic").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_nrm"))
    t = w.join(norm, "topic").withColumn("x", F.col("_w") / F.col("_nrm")).filter(F.abs("x") > eps) \
        .select("topic", "word", "x")
    a = t.select(F.col("topic").alias("ti"), "word", F.col("x").alias("xi"))
    b = t.select(F.col("topic").alias("tj"), "word", F.col("x").alias("xj"))
    return (a.join(b, "word").filter(F.col("ti") != F.col("tj"))
            .groupBy("ti", "tj").agg(F.sum(F.col("xi") * F.col("xj")).alias("sim")))


def _roots(parent: DataFrame, n_nodes: int) -> DataFrame:
    """``(node, root)`` by pointer jumping over ``(node, ptr)`` (ptr = node
    for roots).  After ``r`` rounds every pointer has jumped ``2**r`` steps;
    a chain has fewer than ``n_nodes`` links, so at most ``ceil(log2 n) + 1``
    rounds are needed, and the loop stops earlier once a round changes no
    pointer.  Each round reads the previous one twice, so each is
    checkpointed (else the plan would double every round)."""
    cur = parent.checkpoint()
    rounds = max(1, math.ceil(math.log2(max(n_nodes, 2)))) + 1
    for _ in range(rounds):
        nxt = (cur.alias("a").join(cur.alias("b"), F.col("a.ptr") == F.col("b.node"), "left")
               .select(F.col("a.node").alias("node"),
                       F.coalesce(F.col("b.ptr"), F.col("a.ptr")).alias("ptr"),
                       (F.coalesce(F.col("b.ptr"), F.col("a.ptr")) != F.col("a.ptr")).alias("_moved")))
        nxt = nxt.checkpoint()  # cut lineage in the shared checkpoint folder
        moved = nxt.filter("_moved").limit(1).count() > 0
        cur = nxt.drop("_moved")
        if not moved:
            break
    return cur.select("node", F.col("ptr").alias("root"))


def threshold_groups(sim: DataFrame, topics: DataFrame, thresh: float = 0.15,
                     mode: str = "scan") -> DataFrame:
    """``(topic, grp)``, groups numbered 0.. in order of their first topic.

    ``mode='scan'`` is the reference's order-dependent grouping;
    ``mode='components'`` gives connected components instead."""
    e = sim.filter(F.col("sim") > thresh).select(F.col("ti").alias("i"), F.col("tj").alias("j"))
    # the edge table is small (topics x topics at most); cut its lineage
    # once so the rounds below start from it
    e = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct().checkpoint()
    nodes = topics.select(F.col("topic").alias("node")).distinct()
    if mode == "components":
        # labels spread one link and then jump to their label's label, until a
        # round changes nothing: rounds grow with the logarithm of a chain
        lab = nodes.withColumn("root", F.col("node"))
        changed = True
        while changed:
            m = (e.join(lab.select(F.col("node").alias("j"), F.col("root").alias("rj")), "j")
                 .groupBy(F.col("i").alias("node")).agg(F.min("rj").alias("m")))
            near = (lab.join(m, "node", "left")
                    .select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root")))
            far = lab.select(F.col("node").alias("root"), F.col("root").alias("_far"))
            nxt = near.join(far, "root").select("node", "old", F.least("root", "_far").alias("root")).checkpoint()
            changed = nxt.filter(F.col("root") != F.col("old")).limit(1).count() > 0
            lab = nxt.drop("old")
        g = lab.select(F.col("node").alias("topic"), F.col("root").alias("_g"))
    else:
        par = e.filter(F.col("j") < F.col("i")).groupBy(F.col("i").alias("node")).agg(F.max("j").alias("p"))
        ptr = nodes.join(par, "node", "left").select("node", F.coalesce("p", "node").alias("ptr"))
        roots = _roots(ptr, nodes.count())
        maxnb = e.groupBy(F.col("j").alias("node")).agg(F.max("i").alias("m"))
        g = (nodes.join(maxnb, "node", "left")
             .withColumn("_src", F.coalesce("m", "node"))
             .join(roots.select(F.col("node").alias("_src"), F.col("root").alias("_g")), "_src")
             .select(F.col("node").alias("topic"), "_g"))
    # groups are few (at most the number of topics): rank them in one window
    ranks = g.select("_g").distinct().withColumn("grp", (F.dense_rank().over(Window.orderBy("_g")) - 1).cast("long"))
    return g.join(ranks, "_g").select("topic", "grp")


def merge_counts(hist: DataFrame, groups: DataFrame, topic_col: str = "topic", bin_col: str = "bin",
                 weight_col: str = "weight") -> DataFrame:
    """``(grp, bin, weight)``: topic histograms summed per group."""
    return (hist.join(groups.withColumnRenamed("topic", topic_col), topic_col)
            .groupBy("grp", bin_col).agg(F.sum(weight_col).alias("weight")))


def merge_labels(tw: DataFrame, groups: DataFrame, max_words: int = TOPIC_WORDS) -> DataFrame:
    """``(grp, word)``: a group's label takes the words of its topics in
    topic order while it holds fewer than ``max_words`` words."""
    sizes = tw.groupBy("topic").agg(F.count(F.lit(1)).alias("_k")).join(groups, "topic")
    w = Window.partitionBy("grp").orderBy("topic").rowsBetween(Window.unboundedPreceding, -1)
    taken = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0))) \
        .filter(F.col("_before") < max_words)
    return tw.join(taken.select("topic", "grp"), "topic").select("grp", "word").distinct()


def common_words(labels: DataFrame, key: str = "grp", word: str = "word") -> tuple[DataFrame, DataFrame]:
    """(words in every label, (label, word) pairs not in every label)."""
    n = labels.select(F.countDistinct(key)).scalar()
    cnt = labels.groupBy(word).agg(F.countDistinct(key).alias("_n"))
    common = cnt.filter(F.col("_n") == n).select(word)
    specific = labels.join(common, word, "left_anti")
    return common, specific


def first_words(words: DataFrame, n: int = 10, group: str = "cluster") -> DataFrame:
    """``(group, rank, word)``: the ``n`` words of each group in most messages
    (``df``; ties by word)."""
    top = top_k_per_group(words, [group], [F.col("df").desc(), F.col("word")], n, salt_cols=["word"])
    return top.select(group, "rank", "word")


def topic_vectors(tw: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(topic, dim, value)``: the sum of the vectors of a topic's words
    (words without a vector are skipped)."""
    cells = tw.select("topic", "word").join(vectors.select("word", "vector"), "word").select("topic", F.posexplode("vector").alias("dim", "x"))
    return cells.groupBy("topic", F.col("dim").cast("long").alias("dim")).agg(F.sum("x").alias("value"))
