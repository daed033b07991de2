"""First rows, top rows, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.session import materialized


def head_rows(df: DataFrame, *order: str | Column, n: int = 100) -> DataFrame:
    """First ``n`` rows in a stated order (0 = all); Spark tables have no stored order."""
    if not order:
        raise ValueError("head_rows needs an order")
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n else ordered


def first_per_key(df: DataFrame, key: str, *order: str | Column, n: int = 1) -> DataFrame:
    """First ``n`` rows of each key in a stated order.

    The rank filter is applied per input partition before the shuffle, so a key
    with very many rows sends at most ``n`` rows from each partition.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_index",
                   partitions: int | None = None) -> DataFrame:
    """0-based position in a stated order, computed without a one-task window.

    Rows are range-partitioned, sorted and written once to the shared folder;
    the index is the position inside the partition plus the size of the
    partitions before it (one row per partition). ``order`` should be unique.
    Without ``partitions`` Spark sizes them by the rows' bytes at run time
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): it merges ranges that lie side by side,
    so for a very large table ``spark.sql.shuffle.partitions`` has to be as large as
    its size asks for.
    """
    if not order:
        raise ValueError("with_row_index needs an order")
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = materialized(
        dealt.sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}),
        "row-index",
    )
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select(F.col("_part"), before.alias("_before"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .select((inside + F.col("_before")).alias(name), *df.columns)
    )
