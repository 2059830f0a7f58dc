"""Step 5: time bins and topic histograms over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import relational as R
from murmur.operators import timeline as TL
from murmur.plans.registry import query
from murmur.session import table

SPAN = ("span AS (SELECT min(epoch_us(ts)) AS t0, (max(epoch_us(ts)) - min(epoch_us(ts))) // 100 AS w FROM events), "
        "fb AS (SELECT e.*, (epoch_us(ts) - t0) // w AS f, t0, w, "
        "row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events e, span), "
        "lb AS (SELECT *, (i + min(f - i) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS bin FROM fb), "
        "tw AS (SELECT lb.*, dense_rank() OVER (ORDER BY event_type) - 1 AS topic, value AS weight FROM lb), "
        "hist AS (SELECT topic::BIGINT AS topic, bin, any_value(t0) + bin * any_value(w) AS bin_low_us, "
        "sum(weight) AS weight FROM tw GROUP BY topic, bin) ")


@query("time_bins_exact", "WITH " + SPAN + "SELECT event_id, f::BIGINT AS bin FROM fb")
def time_bins_exact(spark, sf):
    ev = table(spark, sf, "events")
    return TL.with_exact_bins(ev, "ts", 100, "bin").select("event_id", "bin")


@query("time_bins_lagged", "WITH " + SPAN + "SELECT event_id, bin FROM lb")
def time_bins_lagged(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return TL.with_lagged_bins(ev, "ts", "event_id").select("event_id", "bin")


def _hist(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    ev = R.label_encode(ev, "event_type", "topic").withColumnRenamed("value", "weight")
    return TL.topic_histogram(TL.with_lagged_bins(ev, "ts", "event_id"))


@query("bin_topic_histogram", "WITH " + SPAN +
       "SELECT topic, bin, bin_low_us, round(weight, 6) AS weight FROM hist")
def bin_topic_histogram(spark, sf):
    h = _hist(spark, sf)
    return h.select(F.col("topic").cast("long").alias("topic"), "bin", "bin_low_us", F.round("weight", 6).alias("weight"))


@query("bin_share_log10", "WITH " + SPAN +
       ", sh AS (SELECT *, sum(weight) OVER (PARTITION BY bin) + 1e-10 AS total FROM hist) "
       "SELECT topic, bin, round(log10(total), 6) AS log_total, round(log10(total) * weight / total, 6) AS share FROM sh")
def bin_share_log10(spark, sf):
    s = TL.bin_shares(_hist(spark, sf))
    return s.select(F.col("topic").cast("long").alias("topic"), "bin", F.round("log_total", 6).alias("log_total"),
                    F.round("share", 6).alias("share"))


@query("histogram_artifacts", "WITH " + SPAN + "SELECT topic, count(*) AS n_bins, round(sum(weight), 6) AS weight FROM hist GROUP BY topic")
def histogram_artifacts(spark, sf):
    """Histogram written as a topic artefact, read back, pivoted to the dense
    topic x bin form and summarised per topic."""
    import uuid
    from murmur.session import scratch_path
    from murmur.sources import io as IO
    h = _hist(spark, sf).select(F.col("topic").cast("long").alias("topic"), "bin", "bin_low_us", "weight")
    base = scratch_path(spark, f"topics-{uuid.uuid4().hex}")
    IO.write_topic_artifacts(base, histogram=h)
    back = IO.read_topic_artifacts(spark, base)["histogram"]
    wide = TL.histogram_wide(back, TL.N_BINS + 1)
    bins = [c for c in wide.columns if c != "topic"]
    nonzero = sum((F.col(f"`{c}`") != 0).cast("long") for c in bins)
    total = sum(F.col(f"`{c}`") for c in bins)
    return wide.select("topic", nonzero.alias("n_bins"), F.round(total, 6).alias("weight"))
