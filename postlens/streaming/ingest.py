"""Incremental ingest of raw pages into a post store.

Store layout: ``<store>/ingest_run=<run>/ingest_batch=<n>/``. A micro-batch
overwrites its own folder only, so a batch that is run again after a failure
leaves the same rows as one that ran once. The ids stand once more below
``<store>_ids/buckets=<count>/id_bucket=<hash>/``, so a batch reads those of its own buckets and not the store; the count of
buckets doubles as the store grows, so a bucket keeps its size. What a batch took, and a mergeable sketch of its ids, is
observed while it is written and stands below ``<store>_counts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.operators.dedup import SKETCH_LG_K, new_posts_only
from postlens.operators.filters import relevant
from postlens.schema import POST_SCHEMA, RELEVANCE_KEYWORDS

PARTITIONS = "ingest_run string, ingest_batch bigint"
#: Buckets that an id table begins with, and ids in one, on average, before it is split.
ID_BUCKETS, IDS_IN_BUCKET = 16, 2_000_000
#: File that says that an id table's writing has ended; readers of the table pass it over.
WHOLE = "_WHOLE"
COUNTS = "taken bigint, sketch binary"


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All stored posts with their run and batch; empty if nothing is stored yet."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in POST_SCHEMA)
    schema = f"{fields}, {PARTITIONS}"
    try:
        return spark.read.schema(schema).option("basePath", store).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def id_buckets(spark: SparkSession, store: str) -> int:
    """Buckets of the id table in use: the largest table whose writing has ended, so one that was broken off is not seen."""
    files, root = _files(spark, f"{store.rstrip('/')}_ids")
    if not files.exists(root):
        return 0
    found = [f.getPath() for f in files.listStatus(root)]
    counts = [int(p.getName().split("=")[1]) for p in found if p.getName().startswith("buckets=") and _exists(spark, f"{p}/{WHOLE}")]
    return max(counts, default=0)


def _id_root(store: str, buckets: int) -> str:
    return f"{store.rstrip('/')}_ids/buckets={buckets}"


def stored_ids(spark: SparkSession, store: str, wanted: Iterable[int], buckets: int | None = None) -> DataFrame:
    """Stored ids of some buckets with their run and batch; other buckets are neither listed nor read."""
    root = _id_root(store, buckets or id_buckets(spark, store) or ID_BUCKETS)
    paths = [p for b in wanted if _exists(spark, p := f"{root}/id_bucket={b}")]
    schema = f"video_id string, id_bucket int, {PARTITIONS}"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)


def _write_ids(ids: DataFrame, store: str, buckets: int) -> None:
    partitions = ("id_bucket", "ingest_run", "ingest_batch")
    marks = ids.select("video_id", _bucket(buckets).alias("id_bucket"), "ingest_run", "ingest_batch")
    marks.repartition("id_bucket").sortWithinPartitions(*partitions).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(_id_root(store, buckets))
    files, mark = _files(ids.sparkSession, f"{_id_root(store, buckets)}/{WHOLE}")
    files.create(mark, True).close()


def index_store(spark: SparkSession, store: str, buckets: int | None = None) -> int:
    """Write the id table of a store anew; gives its bucket count, by default one that fits the store's rows.

    For a store without one, to join the small files of many batches, or to split its buckets. A table of
    another count is written beside the one in use, which stays until the new one is whole.
    """
    stored = read_store(spark, store)
    if buckets is None:
        buckets = _fitting(stored.count(), id_buckets(spark, store) or ID_BUCKETS)
    _write_ids(stored.select("video_id", "ingest_run", "ingest_batch"), store, buckets)
    files, root = _files(spark, f"{store.rstrip('/')}_ids")
    for f in files.listStatus(root):
        if f.getPath().getName() != f"buckets={buckets}":
            files.delete(f.getPath(), True)
    return buckets


def _fitting(ids: int, buckets: int, most: int | None = None) -> int:
    while ids > buckets * (most or IDS_IN_BUCKET):
        buckets *= 2
    return buckets


def write_batch(posts: DataFrame, store: str, run: str, batch: int, order: Sequence[str] = ("video_id",),
                ids_in_bucket: int | None = None) -> None:
    """Store the posts of one batch that no other batch holds.

    Only the id buckets that the batch falls into are read, so the cost follows the batch and its share of the
    ids. When buckets come to hold more than ``ids_in_bucket`` on average, the id table is written with twice
    as many, so all growing costs no more than a fixed number of writes for each id. An empty result writes nothing.
    """
    spark = posts.sparkSession
    posts = posts.persist()
    try:
        buckets = id_buckets(spark, store) or ID_BUCKETS
        ids = posts.select("video_id").distinct()
        own_buckets = sorted(r[0] for r in ids.select(_bucket(buckets)).distinct().collect())
        own = (F.col("ingest_run") == run) & (F.col("ingest_batch") == batch)
        others = stored_ids(spark, store, own_buckets, buckets).where(~own).select("video_id")
        known = others.join(ids, "video_id", "left_semi").distinct()
        fresh = new_posts_only(posts, known, *order)
        typed = fresh.select(*[F.col(f.name).cast(f.dataType) for f in POST_SCHEMA]).persist()
        try:
            if typed.isEmpty():
                return
            seen = Observation()
            watched = typed.observe(seen, F.count(F.lit(1)).alias("taken"), F.hll_sketch_agg("video_id", F.lit(SKETCH_LG_K)).alias("sketch"))
            watched.write.mode("overwrite").parquet(f"{store}/ingest_run={run}/ingest_batch={batch}")
            _write_ids(typed.select("video_id", F.lit(run).alias("ingest_run"), F.lit(batch).cast("bigint").alias("ingest_batch")), store, buckets)
            counts = spark.createDataFrame([(seen.get["taken"], bytes(seen.get["sketch"]))], COUNTS)
            counts.coalesce(1).write.mode("overwrite").parquet(f"{store.rstrip('/')}_counts/ingest_run={run}/ingest_batch={batch}")
        finally:
            typed.unpersist()
    finally:
        posts.unpersist()
    stored = read_counts(spark, store).agg(F.sum("taken")).first()[0] or 0
    if _fitting(stored, buckets, ids_in_bucket) > buckets:
        index_store(spark, store, _fitting(stored, buckets, ids_in_bucket))


def read_counts(spark: SparkSession, store: str) -> DataFrame:
    """One row for each batch that stored posts: ``taken, sketch`` with its run and number."""
    schema, root = f"{COUNTS}, {PARTITIONS}", f"{store.rstrip('/')}_counts"
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(root)


def start_ingest(source: DataFrame, to_posts: Callable[[DataFrame], DataFrame], store: str,
                 checkpoint: str, run: str, keywords: Sequence[str] = RELEVANCE_KEYWORDS,
                 order: Sequence[str] = ("video_id",), interval: str | None = None) -> StreamingQuery:
    """Start the ingest of a streaming page table.

    ``to_posts`` turns pages into posts (see ``pages_to_posts``). Without an
    ``interval`` all that has arrived is taken and the query ends. ``run`` must
    stay the same for one checkpoint.
    """
    posts = relevant(to_posts(source), keywords)
    writer = posts.writeStream.foreachBatch(
        lambda batch, number: write_batch(batch, store, run, number, order)
    ).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def run_counters(spark: SparkSession, store: str, run: str) -> DataFrame:
    """Posts taken by one run, and rows and distinct ids of the whole store."""
    stored = read_store(spark, store)
    taken = F.count_if(F.col("ingest_run") == run).alias("taken")
    ids = stored.groupBy("video_id").agg(F.count("*").alias("n"), taken)
    return ids.agg(
        F.coalesce(F.sum("taken"), F.lit(0)).alias("taken_in_run"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("video_id").alias("distinct_posts"),
    )


def observed_counters(spark: SparkSession, store: str, run: str) -> DataFrame:
    """As ``run_counters``, from what was observed while the batches were written: one short row for each batch is read, no post.

    A batch stores ids only that no other holds, so rows and distinct ids are the same number.
    """
    taken = F.sum(F.when(F.col("ingest_run") == run, F.col("taken")))
    total = F.coalesce(F.sum("taken"), F.lit(0).cast("bigint"))
    return read_counts(spark, store).agg(F.coalesce(taken, F.lit(0).cast("bigint")).alias("taken_in_run"), total.alias("total_rows"), total.alias("distinct_posts"))


def drop_repeats_within(stream: DataFrame, time: str, delay: str, key: str = "video_id") -> DataFrame:
    """First sight of each id within ``delay`` of event time, with bounded state."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
