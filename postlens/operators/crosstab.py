"""Cross-tabulation of two label columns, in long form.

The table is first reduced to one row per label pair; absent pairs are filled
by pivot and unpivot of that small table, so no cross join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.schema import MARGIN_LABEL

MAX_COLUMN_LABELS = 10_000


class TooManyLabels(ValueError):
    """A column offered as cross-tab columns is not a label column."""


def pair_counts(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Count per label pair as (row_label, col_label, n); rows with a null label are left out."""
    return (
        df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
        .groupBy(F.col(rows).alias("row_label"), F.col(cols).alias("col_label"))
        .agg(F.count("*").alias("n"))
    )


def column_labels(df: DataFrame, cols: str) -> list[str]:
    """Labels present in a column, fetched to name pivot columns; refuses more than 10,000."""
    found = df.select(cols).where(F.col(cols).isNotNull()).distinct().limit(MAX_COLUMN_LABELS + 1)
    labels = sorted(r[0] for r in found.collect())
    if len(labels) > MAX_COLUMN_LABELS:
        raise TooManyLabels(f"{cols} has more than {MAX_COLUMN_LABELS} distinct values")
    return labels


def _filled(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Pairs with a 0 row for every label pair that does not occur."""
    wide = pairs.groupBy("row_label").pivot("col_label", list(labels)).agg(F.sum("n"))
    names = [f"`{c}`" for c in labels]
    return wide.na.fill(0, list(labels)).unpivot("row_label", names, "col_label", "n")


def counts_long(df: DataFrame, rows: str, cols: str, labels: Sequence[str] | None = None) -> DataFrame:
    """All (row_label, col_label, n) cells, zeros included.

    ``labels`` names the possible column labels, which saves a job; those that
    never occur are left out, as if the labels had been looked up.
    """
    known = list(labels) if labels is not None else column_labels(df, cols)
    cells = _filled(pair_counts(df, rows, cols), known)
    if labels is None:
        return cells
    seen = F.sum("n").over(Window.partitionBy("col_label"))
    return cells.withColumn("_seen", seen).where(F.col("_seen") > 0).drop("_seen")


def row_shares(df: DataFrame, rows: str, cols: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Share of each cell in its row."""
    total = F.sum("n").over(Window.partitionBy("row_label"))
    return counts_long(df, rows, cols, labels).select(
        "row_label", "col_label", (F.col("n") / total).alias("share")
    )


def with_margins(df: DataFrame, rows: str, cols: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Counts with row, column and grand totals under the label ``All``.

    The cube runs over the pair counts and not over the table, so rows are not
    multiplied before aggregation.
    """
    known = list(labels) if labels is not None else column_labels(df, cols)
    total = F.lit(MARGIN_LABEL)
    cube = (
        pair_counts(df, rows, cols).cube("row_label", "col_label")
        .agg(F.sum("n").alias("n"), F.grouping("row_label").alias("all_rows"),
             F.grouping("col_label").alias("all_cols"))
        .select(
            F.when(F.col("all_rows") == 1, total).otherwise(F.col("row_label")).alias("row_label"),
            F.when(F.col("all_cols") == 1, total).otherwise(F.col("col_label")).alias("col_label"),
            "n",
        )
        .where(F.col("n").isNotNull())
    )
    cells = _filled(cube, [*known, MARGIN_LABEL])
    if labels is None:
        return cells
    seen = F.sum("n").over(Window.partitionBy("col_label"))
    return cells.withColumn("_seen", seen).where(F.col("_seen") > 0).drop("_seen")


def wide(cells: DataFrame, value: str, labels: Sequence[str]) -> DataFrame:
    """Long cells to one column per label."""
    return cells.groupBy("row_label").pivot("col_label", list(labels)).agg(F.first(value)).na.fill(0)
