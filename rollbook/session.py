"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the run-time work the operators count on: splitting skewed join
# partitions, coalescing small ones, and switching to a broadcast join only when the measured
# size of a side is under the threshold. No operator forces a broadcast.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # processors with their own state and timers need this store
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "rollbook") -> SparkSession:
    """A local session for tests and the bench; on a cluster pass SETTINGS to the submit command."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named in spark.checkpoint.dir.

    It is set here only where the session names none, as in local tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rollbook-checkpoint-"))
    return named or context.getCheckpointDir()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files when their action ends, not when the driver happens to collect its garbage. Only
    for frames whose one action lies inside: a second one would have to shuffle again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder; the shuffle files behind it go at once."""
    shared_folder(df.sparkSession)
    with brief_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for loops: a checkpoint keeps the size that Spark guesses from the joins behind it,
    a guess that grows from round to round until planning takes longer than the work; of a table Spark knows the size."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4()}"
    with brief_shuffles(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
