"""A corpus pipeline: toxicity, language, near copies, repeats, packing.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)``, works
on all rows of ``docs`` and returns the rows that go on (the last one: pieces of
packed sequences).  ``run`` writes what each stage returns to the shared folder
and reads it as the next one's documents.  A stage starts once the one before is
written, so it first drops the working tables that earlier ones left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from murmur.llm import jaccard_tree, langid, packing, suffix_tree, toxicity
from murmur.llm.common import documents, on_workers, release_all_but, written
from murmur.llm.queries import remainder
from murmur.session import table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the string-kernel machine predicts to be toxic.
    It learns from the labelled documents outside fold 0."""
    machine = toxicity.train(docs.where(remainder() != 0), table(on_workers(spark), sf_dir, "labels"))
    return toxicity.kept(docs, machine)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those in which no language
    reaches a pooled probability of 0.4.  Learns from rows outside fold 0."""
    return langid.kept(docs, langid.train(docs.where(remainder() != 0)), 0.4)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five words, 0.8)."""
    return jaccard_tree.one_of_each(release_all_but(docs), 5, 80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words in windows of 20 words that also start earlier."""
    return suffix_tree.without_repeats(release_all_but(docs), 20)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids along the curve."""
    return packing.pack(release_all_but(docs), public_tokenizers.path("word_bpe_49k.json"), 2048, 1, with_ids=False)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]

#: Learned models and tokenizers can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
