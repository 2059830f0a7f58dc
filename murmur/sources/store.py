"""Fitted models under a key of everything that made them.

A model is looked up by kind and parameters (and a hash of the data it is fitted
on).  It is written to a folder of its own, then published by a row in another; readers only see published folders.  A fit that is cut short leaves a
folder nobody reads, and the next run fits anew; two fits at once publish two
equal models, of which all readers take the first by name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import scratch_path


def model_key(kind: str, **params) -> str:
    """Folder name of a model: its kind and a digest of all parameters."""
    text = json.dumps(params, sort_keys=True, default=str)
    return f"{kind}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def content_mark(df: DataFrame, *columns: str | Column) -> str:
    """A mark of the rows of ``df``, whatever their order: rows that differ, or
    that other rules made, give another one."""
    h = F.xxhash64(*columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("s")).first()
    return f"{r.n}:{r.x}:{r.s}"


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the model published at ``path``, or None."""
    try:
        row = spark.read.schema("folder string").option("recursiveFileLookup", True).json(f"{path}/published").agg(F.min("folder").alias("f")).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return f"{path}/{row.f}" if row.f else None


def load_or_fit(spark: SparkSession, path: str, load: Callable, fit: Callable, save: Callable | None = None):
    """The model published at ``path`` (``load(folder)``), or what ``fit()``
    returns, saved (``save(model, folder)``; Spark ML models save themselves)
    and published there."""
    there = published(spark, path)
    if there is None:
        model, folder = fit(), f"model-{uuid.uuid4().hex}"
        if save is None:
            model.write().overwrite().save(f"{path}/{folder}")
        else:
            save(model, f"{path}/{folder}")
        spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.json(f"{path}/published/{folder}")
        there = published(spark, path)
    return load(there)


def stored(spark: SparkSession, kind: str, params: dict, load: Callable, fit: Callable, save: Callable | None = None, base: str | None = None):
    """:func:`load_or_fit` under the key of ``kind`` and ``params``."""
    return load_or_fit(spark, f"{base or scratch_path(spark, 'models')}/{model_key(kind, **params)}", load, fit, save)
