"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class ConfigError(RuntimeError):
    """A setting that the job cannot do without is missing."""


def build_session(app_name: str = "postlens", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "12g") -> SparkSession:
    """Session with the settings this package is tuned for.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: the
    submit command names the master and AQE sizes the partitions.
    ``driver_memory`` counts in local mode only, where one JVM does all the work.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.driver.host", "127.0.0.1")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.ui.enabled", "false")
                .config("spark.driver.memory", driver_memory)
            )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A machine-local temporary folder is used in local mode only; a cluster
    session without the setting is refused.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ConfigError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="run-")
    return _local_root


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/postlens/{spark.sparkContext.applicationId}"


_scopes: list[list[str]] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for this session below the shared folder; it belongs to the innermost ``work_scope``."""
    path = f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def session_path(spark: SparkSession, name: str) -> str:
    """The same path for each call of one session, below the shared folder; it stays until ``discard_work``."""
    return f"{_session_folder(spark)}/{name}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Working copies written inside are deleted at its end, so results must be written or fetched before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def discard_work(spark: SparkSession) -> None:
    """Delete what this session has written to its part of the shared folder."""
    _delete(spark, _session_folder(spark))


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a re-run
    of the chain behind ``df``, and fixes values that depend on partitioning. The
    copy stays until its ``work_scope`` ends, or ``discard_work``.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-bound chain one partition per core when the scan keeps most cores idle.

    Meant for a plain scan of a few unsplittable files. A scan with splits for
    half of the cores or more is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)
