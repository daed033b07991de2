"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import work_path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    A lost executor then costs a re-read, and values that depend on the
    partitioning are fixed. ``forget`` deletes the copy.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete copies made by ``keep``; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough for local mode and for clusters that have it in the same place; others get it by ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is empty.

    Taking them out first keeps other columns, whatever their names, away from
    an operator's own.
    """
    worker_path(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def same(a: Column, b: Column) -> Column:
    """Equality for join keys that may be null."""
    return a.eqNullSafe(b)
