"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. A cluster session keeps its own sizes;
# `shuffle_partitions` is only a start value, AQE coalesces and splits at run time.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_own_root: str | None = None
_scope: ContextVar[str] = ContextVar("postloom_staging", default="session")


def local_session(app: str = "postloom", cpus: int | str = "*", shuffle_partitions: int = 8,
                  **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = dict(RECOMMENDED)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings["spark.ui.enabled"] = "false"
    settings["spark.driver.memory"] = os.environ.get("POSTLOOM_DRIVER_MEMORY", "12g")
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_shared_folder(path: str) -> None:
    """The folder for sessions without ``spark.checkpoint.dir``, as in tests."""
    global _own_root
    _own_root = path.rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or what ``use_shared_folder`` named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_root
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return root.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a block; those from before come back behind it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def staging() -> Iterator[str]:
    """Tables staged inside go to one folder, whose name this gives; ``release`` removes it."""
    name = uuid.uuid4().hex
    token = _scope.set(name)
    try:
        yield name
    finally:
        _scope.reset(token)


def release(spark: SparkSession, name: str) -> None:
    """Remove the tables of a ``staging`` block; what reads them is not usable any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/staged/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# How parquet files with long texts are packed.
TEXT_CODEC = "zstd"


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; tables of texts are packed by ``TEXT_CODEC``.

    Used where several outputs hang on one expensive table: a lost executor then re-reads
    files instead of recomputing the whole lineage.
    """
    path = f"{shared_root(df.sparkSession)}/staged/{_scope.get()}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
