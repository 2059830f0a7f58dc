"""Session and table helpers shared by operators, queries, tests and bench."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Bytes of rows that go to a Python worker at once: Spark holds 256 MB otherwise, twice a task.
ARROW_BYTES = 16 << 20


def get_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                app: str = "murmur") -> SparkSession:
    """Local session tuned like a small cluster: AQE on, UI off, UTC clock."""
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; only when it is unset in local mode (tests) a scratch folder
    is chosen, on a cluster that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="murmur-ckpt-", dir=os.environ.get("MURMUR_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Spark send a worker ``ARROW_BYTES`` of rows at once at most: with more text
    or longer rows a batch must not grow."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not (now.isdigit() and 0 < int(now) <= ARROW_BYTES):
        spark.conf.set(key, str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    A scan of one large row group yields one task; CPU-heavy text rules would
    then run on a single core.  Scans that already have enough partitions (any
    cluster-sized input) are returned unchanged, so this never adds a shuffle
    at scale.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        # persisted, because Catalyst pushes filters below a repartition:
        # a filter on tokens would otherwise run the text rules in the one
        # scan task.  Only small single-split inputs take this branch.
        return df.repartition(want).persist(StorageLevel.MEMORY_AND_DISK)
    return df
