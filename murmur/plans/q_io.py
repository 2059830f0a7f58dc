"""Steps 11-12: file round trips, fixed projections and the tracked stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from murmur.plans import sqltext as st
from murmur.plans.q_relational import KEYWORDS
from murmur.plans.registry import query
from murmur.session import scratch_path, table
from murmur.sources import io as IO
from murmur.streaming import track as TR
from murmur.streaming.backfill import Backfill

EVENT_FIELDS = ["event_id", "ts", "user_id", "event_type", "value", "props", "lang"]
STREAM_FIELDS = ["doc_id", "lang", "source", "place"]


@query("csv_roundtrip", f"SELECT doc_id::VARCHAR AS id_str, {st.norm_format('text')} AS text, lang AS label FROM documents")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id_str"), "text",
                                                F.lit("Wed Jan 03 10:00:00 +0000 2024").alias("created_at"),
                                                F.col("lang").alias("label"))
    IO.write_csv(docs, path)
    back = IO.read_messages(spark, path, ["id_str", "text", "label"])
    return back


# Rows of these kinds, by doc_id % 10: a stray quote before an unquoted text
# (3), an unquoted text whose own commas cut it (5), a row without its label (7).
# All others are well formed: quoted, with commas, quotes and lines inside.
_FLAT = "regexp_replace(text, '[\\r\\n\"]+', ' '{g})"


@query("csv_repair", f"""SELECT doc_id::VARCHAR AS id_str,
    {st.norm_format("CASE WHEN doc_id % 10 IN (3, 5) THEN " + _FLAT.format(g=", 'g'") + " ELSE text END")} AS text,
    CASE WHEN doc_id % 10 = 7 THEN NULL ELSE lang END AS label FROM documents""")
def csv_repair(spark, sf):
    """Messages written as raw lines, well-formed ones among broken ones (a
    stray quote glues what follows), read back without losing a word."""
    path = scratch_path(spark, f"broken-{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.expr(_FLAT.format(g="")).alias("flat"), "lang", (F.col("doc_id") % 10).alias("kind"))
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    body = (F.when(F.col("kind") == 3, F.concat(F.lit('"'), "flat")).when(F.col("kind") == 5, F.col("flat")).otherwise(quoted))
    label = F.when(F.col("kind") == 7, F.lit("")).otherwise(F.concat(F.lit(","), F.col("lang")))
    docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(","), body, label).alias("value")).write.text(path)
    return IO.read_messages(spark, path, ["id_str", "text", "label"], header_fields=["id_str", "text", "label"], header=False)


@query("na_projection", "SELECT " + ", ".join(
    [f"coalesce({c}::VARCHAR, 'NA') AS {c}" for c in EVENT_FIELDS[:-1]] + ["'NA' AS lang"]) + " FROM events")
def na_projection(spark, sf):
    return IO.na_projection(table(spark, sf, "events"), EVENT_FIELDS)


# a message made of a document: the values of its nested fields, (Spark, DuckDB);
# fields that are not named are missing, null ones come back as NA, too
_HARVEST = {
    "text": "text", "id_str": "CAST(doc_id AS STRING)", "lang": "lang", "source": "source", "retweet_count": "n_chars", "favorited": "doc_id % 2 = 0",
    "created_at": "'Wed Jan 03 10:00:00 +0000 2024'", "in_reply_to_screen_name": "CASE WHEN doc_id % 3 = 0 THEN concat('u', doc_id % 7) END",
    "user.id_str": "CAST(doc_id % 50 AS STRING)", "user.screen_name": "concat('u', doc_id % 50)", "user.name": "concat('Ünï, \"', source, '\"')",
    "user.followers_count": "n_chars % 100", "user.verified": "doc_id % 5 = 0", "user.lang": "lang", "user.url": "concat('http://h/', doc_id)",
    "user.created_at": "'2020'", "user.description": "CAST(NULL AS STRING)", "user.utc_offset": "-3600", "user.time_zone": "CASE WHEN doc_id % 4 = 0 THEN 'UTC' END",
    "place.country_code": "CASE WHEN doc_id % 2 = 1 THEN upper(lang) END", "place.name": "CASE WHEN doc_id % 2 = 1 THEN source END", "place.id": "CAST(doc_id % 11 AS STRING)",
}
# lists: the whole path, and the Spark expression of the list
_HARVEST_LISTS = {
    "coordinates.coordinates": "CASE WHEN doc_id % 3 > 0 THEN array(doc_id % 180, doc_id % 90) END",
    "place.bounding_box.coordinates": "array(array(array(doc_id % 60, doc_id % 70)))",
    "entities.urls": "CASE WHEN doc_id % 2 = 0 THEN array(named_struct('url', concat('u', doc_id), 'expanded_url', concat('http://x/', doc_id))) ELSE array() END",
}
_HARVEST_SQL = {"lat": "CASE WHEN doc_id % 3 > 0 THEN doc_id % 90 END", "lon": "CASE WHEN doc_id % 3 > 0 THEN doc_id % 180 END", "place_lat": "doc_id % 70", "place_lon": "doc_id % 60",
                "url": "CASE WHEN doc_id % 2 = 0 THEN concat('u', doc_id) END", "expanded_url": "CASE WHEN doc_id % 2 = 0 THEN concat('http://x/', doc_id) END"}


def _nested(values: dict[str, str]) -> str:
    """One ``named_struct`` of values by path."""
    parts: dict = {}
    for path, e in values.items():
        head, _, rest = path.partition(".")
        parts.setdefault(head, {})[rest] = e
    return "named_struct(" + ", ".join(f"'{h}', " + (v[""] if "" in v else _nested(v)) for h, v in parts.items()) + ")"


def _harvest_columns(flat: str = "") -> str:
    out = []
    for name, path in IO.HARVEST_FIELDS.items():
        e = _HARVEST.get(path) or _HARVEST_SQL.get(name)
        e = e.replace("STRING", "VARCHAR") if e else None
        out.append(f"coalesce(({e})::VARCHAR, 'NA') AS \"{name}\"" if e else f"'NA' AS \"{name}\"")
    return ", ".join(out)


def _write_harvest(spark, sf):
    path = scratch_path(spark, f"harvest-{uuid.uuid4().hex}")
    message = F.expr(_nested(_HARVEST | _HARVEST_LISTS))
    table(spark, sf, "documents").select(F.to_json(message).alias("value")).write.text(path)
    return path


@query("harvest_fields", f"SELECT {_harvest_columns()} FROM documents")
def harvest_fields(spark, sf):
    """JSON messages read back as the fixed list of 42 fields."""
    return IO.read_harvest(spark, _write_harvest(spark, sf))


_TRACK = "(?i)(" + "|".join(KEYWORDS) + ")"


@query("track_stream", "SELECT doc_id::VARCHAR AS doc_id, lang, source, 'NA' AS place FROM documents "
       f"WHERE regexp_matches(text, {st.lit(_TRACK)})")
def track_stream(spark, sf):
    docs = table(spark, sf, "documents")
    run = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    s = TR.keyword_stream(spark, TR.table_files(sf, "documents"), docs.schema, KEYWORDS, STREAM_FIELDS)
    TR.run_to_sink(s, f"{run}/out", f"{run}/ckpt")
    return spark.read.schema(", ".join(f"{c} string" for c in STREAM_FIELDS)).parquet(f"{run}/out")


@query("harvest_stream", f"SELECT {_harvest_columns()} FROM documents WHERE regexp_matches(text, {st.lit(_TRACK)})")
def harvest_stream(spark, sf):
    """The stream of JSON messages that match a keyword, as the 42 fields."""
    run = scratch_path(spark, f"harvest-run-{uuid.uuid4().hex}")
    TR.run_to_sink(TR.harvest_stream(spark, _write_harvest(spark, sf), KEYWORDS), f"{run}/out", f"{run}/ckpt")
    return spark.read.schema(", ".join(f"`{c}` string" for c in IO.HARVEST_FIELDS)).parquet(f"{run}/out")


@query("backfill_resumed", """WITH m AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id DESC) - 1 AS r FROM documents
  WHERE doc_id > 20 AND doc_id <= (SELECT max(doc_id) - 5 FROM documents) AND contains(text, 'a'))
SELECT doc_id, lang, r // 300 AS batch, r % 300 // 100 AS page FROM m""")
def backfill_resumed(spark, sf):
    """A backfill killed after a batch was written and before its cursor was, and
    gone on with by another run: no row lost, none twice."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, f"backfill-{uuid.uuid4().hex}")
    top = docs.agg(F.max("doc_id")).first()[0]
    make = lambda: Backfill(docs, path, "doc_id", 20, top - 5, F.contains("text", F.lit("a")), 100, 3)
    first = make().run(1)
    killed = first.publish

    def dies(*_):
        raise InterruptedError
    first.publish = dies
    try:
        first.step()
    except InterruptedError:
        first.publish = killed
    return make().run().rows().select("doc_id", "lang", "batch", "page")


@query("stream_count", "SELECT count(*) AS n_messages FROM documents")
def stream_count(spark, sf):
    docs = table(spark, sf, "documents")
    run = scratch_path(spark, f"count-{uuid.uuid4().hex}")
    s = spark.readStream.schema(docs.schema).parquet(TR.table_files(sf, "documents"))
    TR.running_count(s, f"{run}/out", f"{run}/ckpt")
    return spark.read.parquet(f"{run}/out")
