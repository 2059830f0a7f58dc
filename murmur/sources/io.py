"""Readers and writers of the message-mining file formats.

All are Spark data sources; paths may be on any Hadoop file system.  Write
targets should be shared storage on a cluster (for scratch output use
:func:`murmur.session.scratch_path`, under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.text import normalize_format, normalize_punctuation, split_words
from murmur.sources.records import read_records

MESSAGE_FIELDS = ["id_str", "text", "created_at", "label"]

# Score-log columns in the order the experiment writes them (fixed values).
SCORE_LOG_SCHEMA = T.StructType([
    T.StructField("n_trial", T.IntegerType()), T.StructField("i", T.IntegerType()),
    T.StructField("name", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("p", T.DoubleType()), T.StructField("thresh", T.DoubleType()),
    T.StructField("n_rows", T.IntegerType()), T.StructField("corpus_size", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()), T.StructField("n_components", T.IntegerType()),
    T.StructField("clf_base", T.StringType()),
])


def parse_created_at(x: Column) -> Column:
    """ISO-like strings, or the ``Www Mmm dd HH:mm:ss +zzzz yyyy`` form (the
    weekday is skipped: Spark patterns cannot parse it)."""
    return F.coalesce(F.try_to_timestamp(x),
                      F.try_to_timestamp(F.substring(x, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))


def read_messages(spark: SparkSession, path: str, fields: list[str] | None = None,
                  header_fields: list[str] | None = None, header: bool = True) -> DataFrame:
    """CSV message scan with a header (UTF-8, bad bytes -> U+FFFD, doubled
    quotes, quoted line breaks).  Keeps the named fields (a missing one
    raises), trims ids, normalises line breaks in text and parses dates.

    Files are read in splits, also where quoted cells hold line breaks, and
    records that a stray quote glued together, or that have too many or too few
    cells, are repaired (see :mod:`murmur.sources.records`); pieces still short keep NULLs.
    """
    fields = fields or MESSAGE_FIELDS
    head = header_fields or spark.read.option("header", True).csv(path).columns
    missing = [f for f in fields if f not in head]
    if missing:
        raise ValueError(f"fields {missing} not in header {head}")
    return clean_messages(read_records(spark, path, head, skip_header=header).select(*fields))


def clean_messages(df: DataFrame) -> DataFrame:
    out = df
    if "id_str" in df.columns:
        out = out.withColumn("id_str", F.regexp_replace("id_str", r"(?U)^\s+|\s+$", ""))
    if "text" in df.columns:
        out = out.withColumn("text", normalize_format("text"))
    if "created_at" in df.columns:
        out = out.withColumn("created_at", parse_created_at(F.col("created_at")))
    return out


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One term per line, stripped; blank lines dropped; ``(word)``."""
    t = spark.read.text(path)
    return t.select(F.trim("value").alias("word")).filter(F.col("word") != "")


def read_probe_words(spark: SparkSession, path: str) -> DataFrame:
    """``positive words : negative words`` per line -> ``(line, positive, negative)``."""
    t = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = F.split("value", ":")
    ws = r"\s+"
    return t.select("line",
                    F.filter(F.split(F.trim(F.get(parts, 0)), ws), lambda x: x != "").alias("positive"),
                    F.filter(F.split(F.trim(F.coalesce(F.get(parts, 1), F.lit(""))), ws), lambda x: x != "").alias("negative"))


def read_score_log(spark: SparkSession, path: str) -> DataFrame:
    """Score log CSV with an explicit schema; ``name_id`` numbers names from 1
    in order of first appearance (by ``n_trial, i``)."""
    log = spark.read.schema(SCORE_LOG_SCHEMA).option("header", False).csv(path).withColumn("name", F.trim("name"))
    first = log.groupBy("name").agg(F.min(F.struct("n_trial", "i")).alias("_f"))
    from pyspark.sql import Window
    # one row a name, i.e. an experiment; names that start together go by name
    ids = first.withColumn("name_id", F.row_number().over(Window.orderBy("_f", "name")).cast("long")).drop("_f")
    return log.join(ids, "name")


def read_text_corpus(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """One document per file: ``(file, text)``; ``prefix`` keeps files whose
    base name starts with it."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"),
                                                      F.col("value").alias("text"))
    return t.filter(F.col("file").startswith(prefix)) if prefix else t


def read_json_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def na_projection(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fixed ordered projection: every field as text, ``NA`` when missing or null."""
    cols = []
    for f in fields:
        c = F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")
        cols.append(F.coalesce(c, F.lit("NA")).alias(f))
    return df.select(*cols)


# The fields of a harvested message, in the order they are written, and where
# each stands in the message (fixed values).
HARVEST_FIELDS = {
    "text": "text", "retweet_count": "retweet_count", "favorited": "favorited", "truncated": "truncated", "id_str": "id_str",
    "in_reply_to_screen_name": "in_reply_to_screen_name", "source": "source", "retweeted": "retweeted", "created_at": "created_at",
    "in_reply_to_status_id_str": "in_reply_to_status_id_str", "in_reply_to_user_id_str": "in_reply_to_user_id_str", "lang": "lang",
    "listed_count": "user.listed_count", "verified": "user.verified", "location": "user.location", "user_id_str": "user.id_str",
    "description": "user.description", "geo_enabled": "user.geo_enabled", "user_created_at": "user.created_at",
    "statuses_count": "user.statuses_count", "followers_count": "user.followers_count", "favourites_count": "user.favourites_count",
    "protected": "user.protected", "user_url": "user.url", "name": "user.name", "time_zone": "user.time_zone", "user_lang": "user.lang",
    "utc_offset": "user.utc_offset", "friends_count": "user.friends_count", "screen_name": "user.screen_name",
    "country_code": "place.country_code", "country": "place.country", "place_type": "place.place_type", "full_name": "place.full_name",
    "place_name": "place.name", "place_id": "place.id", "place_lat": "place.bounding_box.coordinates[0][0][1]",
    "place_lon": "place.bounding_box.coordinates[0][0][0]", "lat": "coordinates.coordinates[1]", "lon": "coordinates.coordinates[0]",
    "expanded_url": "entities.urls[0].expanded_url", "url": "entities.urls[0].url",
}


def path_steps(path: str) -> list[str | int]:
    """``a.b[0].c`` as ``["a", "b", 0, "c"]``."""
    return [int(x) if x.isdigit() else x for x in re.findall(r"[^.\[\]]+", path)]


def schema_of_paths(paths: list[str]) -> T.DataType:
    """The JSON type that holds all paths; whatever stands at their ends is read as text."""
    def build(steps: list[list]) -> T.DataType:
        if any(not s for s in steps):
            return T.StringType()
        if all(isinstance(s[0], int) for s in steps):
            return T.ArrayType(build([s[1:] for s in steps]))
        names = dict.fromkeys(s[0] for s in steps)
        return T.StructType([T.StructField(n, build([s[1:] for s in steps if s[0] == n])) for n in names])
    return build([path_steps(p) for p in paths])


def flattened(messages: DataFrame, json_col: str = "value", fields: dict[str, str] | None = None) -> DataFrame:
    """One text column a field from a column of JSON messages, batch or stream;
    what is missing or null is ``NA``.  A line that is no JSON has ``NA`` everywhere."""
    fields = fields or HARVEST_FIELDS
    parsed = messages.select(F.from_json(json_col, schema_of_paths(list(fields.values()))).alias("m"))

    def at(path: str) -> Column:
        c = F.col("m")
        for step in path_steps(path):
            c = F.get(c, F.lit(step)) if isinstance(step, int) else c.getField(step)
        return F.coalesce(c, F.lit("NA"))
    return parsed.select(*[at(p).alias(n) for n, p in fields.items()])


def read_harvest(spark: SparkSession, path: str) -> DataFrame:
    """Harvested messages (JSON lines) as the fixed list of fields."""
    return flattened(spark.read.text(path))


# ---- sinks -------------------------------------------------------------------

def write_csv(df: DataFrame, path: str, mode: str = "overwrite", quote_all: bool = True) -> None:
    """Header CSV, inner quotes doubled (cleaned text, labelled rows,
    positives, keyword-filtered rows, score logs with ``mode='append'``)."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("quoteAll", quote_all).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def labelled_for_output(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``id_str, text, label`` with the label as ``T``/``F``."""
    lab = F.when(F.col(label_col).cast("string").isin("1", "T", "true"), "T").otherwise("F")
    return df.select("id_str", "text", lab.alias("label"))


def write_libsvm(df: DataFrame, path: str, label_col: str = "label", features_col: str = "features") -> None:
    """LIBSVM rows; 0/1 labels become -1/+1 (zero features are omitted)."""
    out = df.select(((F.col(label_col).cast("double") - 0.5) * 2).alias("label"), F.col(features_col).alias("features"))
    out.write.mode("overwrite").format("libsvm").save(path)


def cleaned_name(base: str, fields: list[str], by: str | None = None) -> str:
    """Name of a cleaned file: the base name, ``_short_``, ``sorted_`` if it is
    sorted, and the fields."""
    stem = re.sub(r"\.[^./]*$", "", base)
    return f"{stem}_short_{'sorted_' if by else ''}{'_'.join(fields)}"


def write_cleaned(messages: DataFrame, base: str, fields: list[str], by: str | None = None) -> str:
    """The named fields and the normalised text (``normalized``) of messages as
    CSV, sorted by a field if asked to; returns the path."""
    rows = messages.select(*fields, normalize_punctuation(normalize_format("text")).alias("normalized"))
    path = cleaned_name(base, fields, by)
    write_csv(rows.orderBy(by) if by else rows, path)
    return path


def write_matching(messages: DataFrame, keywords: list[str], base: str, suffix: str = "political") -> str:
    """Messages whose tokens contain a keyword, as CSV ``<base>_<suffix>``."""
    from murmur.operators.relational import keyword_filter
    tokens = messages.withColumn("_t", split_words(normalize_punctuation(normalize_format("text"))))
    path = f"{base}_{suffix}"
    write_csv(keyword_filter(tokens, keywords, "_t").drop("_t"), path)
    return path


def write_topic_lists(definitions: DataFrame, path: str) -> None:
    """One line a topic: its number, a tab, then ``weight word`` pairs, heaviest
    first, parted by commas."""
    pair = F.struct((-F.col("weight")).alias("w"), "word")
    line = F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat_ws(" ", (-p["w"]).cast("string"), p["word"]))
    rows = definitions.groupBy("topic").agg(F.concat(F.col("topic").cast("string"), F.lit("\t"), F.array_join(line, ",")).alias("value"))
    rows.select("value").write.mode("overwrite").text(path)


def read_topic_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, rank, word, weight)`` of the lines of :func:`write_topic_lists`."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(parts, 0).cast("long").alias("topic"), F.posexplode(F.split(F.get(parts, 1), ",")).alias("at", "pair"))
    cells = F.split("pair", " ")
    return rows.select("topic", (F.col("at") + 1).cast("long").alias("rank"), F.get(cells, 1).alias("word"), F.get(cells, 0).cast("double").alias("weight"))


def write_lines(df: DataFrame, line_col: str, path: str) -> None:
    df.select(line_col).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None if nothing is there.  Any other
    error (no permission, store not reachable) is the caller's to see."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it back (reuse if it exists).  A table that
    exists is never overwritten."""
    spark = df.sparkSession
    there = read_if_there(spark, path)
    if there is None:
        df.write.mode("errorifexists").parquet(path)
        there = spark.read.parquet(path)
    return there


def write_topic_artifacts(base: str, definitions: DataFrame | None = None, histogram: DataFrame | None = None,
                          labels: DataFrame | None = None) -> None:
    """Topic definitions ``(topic, rank, word, weight)``, the histogram long
    table ``(topic, bin, bin_low_us, weight)`` and topic labels ``(topic,
    label)``, whichever are given, as parquet under ``base``."""
    for name, df in (("definitions", definitions), ("histogram", histogram), ("labels", labels)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{base}/{name}")


def read_topic_artifacts(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of :func:`write_topic_artifacts`, by name."""
    out = {}
    for name in ("definitions", "histogram", "labels"):
        there = read_if_there(spark, f"{base}/{name}")
        if there is not None:
            out[name] = there
    return out
