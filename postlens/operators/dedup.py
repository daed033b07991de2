"""New posts against stored posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.ranking import first_per_key
from postlens.schema import MAX_POSTS_PER_RUN

#: Registers of a distinct-count sketch, as a power of two. The standard error of its estimate is about 0.83 / sqrt(2 ** lg_k).
SKETCH_LG_K = 12


def new_posts_only(incoming: DataFrame, seen: DataFrame, *order: str | Column,
                   key: str = "video_id") -> DataFrame:
    """Incoming posts whose id is not stored, each id once (the first in ``order``).

    Copies are dropped first: that step reduces a hot id inside each input
    partition, and its output is already partitioned for the anti join. The
    same holds for the stored ids.
    """
    unique = first_per_key(incoming, key, *(order or (key,)))
    return unique.join(seen.select(key).distinct(), key, "left_anti")


def seen_after_batch(seen: DataFrame, taken: DataFrame, key: str = "video_id") -> DataFrame:
    return seen.select(key).union(taken.select(key)).distinct()


def sample_new_posts(incoming: DataFrame, seen: DataFrame, n: int = MAX_POSTS_PER_RUN,
                     seed: int = 42, key: str = "video_id", order: tuple = ()) -> DataFrame:
    """``n`` new posts drawn without repeats; the same seed draws the same posts."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return new_posts_only(incoming, seen, *order, key=key).orderBy(draw, key).limit(n)


def ingest_summary(store: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows and distinct ids of the store.

    The ids are first reduced to one row each, so the count is of rows and no
    set is held in one task.
    """
    ids = store.groupBy(key).agg(F.count("*").alias("n"))
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(key).alias("distinct_posts"),
    )


def id_sketches(rows: DataFrame, *by: str, key: str = "video_id", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """One mergeable sketch of the distinct ids for each group of ``by``: a few kilobytes, whatever the rows.

    Null ids are not counted; a group without ids has an empty sketch.
    """
    return rows.groupBy(*by).agg(F.hll_sketch_agg(key, F.lit(lg_k)).alias("sketch"))


def estimated_distinct(sketches: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """``estimate, low, high``: distinct ids over all sketches, united without reading an id again.

    The bounds are three standard errors wide, so about 1 of 370 estimates of many ids lies outside.
    """
    estimate = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("bigint"))
    error = 3 * 0.83 / 2 ** (lg_k / 2)
    return sketches.agg(estimate.alias("estimate")).select(
        "estimate", F.floor(F.col("estimate") / (1 + error)).alias("low"), F.ceil(F.col("estimate") / (1 - error)).alias("high"))
