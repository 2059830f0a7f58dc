"""A backfill to the end: one pass for ids that stand once, batch by batch otherwise."""

import tempfile

from pyspark.sql import functions as F

from murmur.streaming.backfill import Backfill


def job(source, first=None):
    b = Backfill(source, tempfile.mkdtemp(prefix="murmur-test-"), "id", 3, 200, F.col("id") % 2 == 0, page_size=2, max_pages=2)
    return b if first is None else b.run(first)


def stepwise(source):
    b = job(source)
    while b.step():
        pass
    return b


def contents(b):
    return [sorted(map(str, df.collect())) for df in (b.rows().select("id", "page", "batch"), b.cursors())]


def test_the_rest_is_one_pass_with_the_batches_of_steps(spark, monkeypatch):
    source = spark.range(0, 151)
    want = contents(stepwise(source))
    for first in (None, 1, 3):
        b, steps = job(source, first), []
        plain = b.step
        monkeypatch.setattr(b, "step", lambda: steps.append(1) or plain())
        assert contents(b.run()) == want
        assert len(steps) == 1  # the empty one at the end
    assert job(source).run().run().cursors().count() == len(want[1])


def test_repeated_ids_go_step_by_step(spark):
    source = spark.range(0, 21).unionByName(spark.range(10, 13)).unionByName(spark.range(10, 13))
    assert contents(job(source).run()) == contents(stepwise(source))
