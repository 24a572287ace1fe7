"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    A local session without the setting gets a folder of its own; on a cluster
    its absence is an error, since executors cannot read the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def output_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` at reliable storage so that a lost executor
    cannot force a long iterative plan to be recomputed."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch of texts or blocks of numbers. Each task holds a batch in the executor and in its Python worker, some twice.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands rows to Python in batches of about BATCH_BYTES from now on, unless it has a bound of its own."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf.get(bound, None):
        df.sparkSession.conf.set(bound, str(BATCH_BYTES))
    return df


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame several passes read; lost blocks are recomputed."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> None:
    """Unpersist what earlier estimations kept."""
    while _kept:
        df = _kept.pop()
        if df.sparkSession.sparkContext._jsc is not None:  # its session may have ended
            df.unpersist()
