"""Spark session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Semantics first: UTC dates, ANSI casts. The rest lets AQE size and split shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(app: str = "credence", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("credence.staging", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="credence-")
    spark.conf.set("credence.staging", root)
    return root


_open: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _open.get() is not None:
        _open.get().append(path)
    return path


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Staged tables made inside the block are removed at its end: for work that repeats, such as
    micro-batches. Results must be written elsewhere before that."""
    paths: list[str] = []
    token = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, name: str, read_as: StructType | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    This cuts lineage, survives lost executors, lets several consumers prune columns from one
    computed result, and gives the planner the real size, so that it broadcasts a staged table
    only while that is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(read_as or df.schema).parquet(path)
