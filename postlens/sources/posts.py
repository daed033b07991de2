"""Post tables: CSV and parquet, reading, appending, publishing, exporting."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.counts import coerce_count
from postlens.functions.records import records_from_json, records_to_json
from postlens.schema import (
    POST_COLUMNS, POST_SCHEMA, EmptySourceError, MissingSourceError, SchemaError,
)

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
#: A file whose header is not that of the others is an error, not a column under a wrong name.
ONE_HEADER = {"enforceSchema": "false"}
COUNTS = ("likes", "comments", "saves")
RENAMED = {"shares": "saves"}
MOST_HEADERS = 1000
POINTER = "CURRENT"


def _read(spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    try:
        return spark.read.format(fmt).options(**options).load(path, schema=schema)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise MissingSourceError(f"no such source: {path}") from e
        if e.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE.NO_HINT"):
            raise EmptySourceError(f"source holds no data: {path}") from e
        raise


def _typed(name: str) -> Column:
    """CSV text of a post column in its canonical type."""
    if name in COUNTS:
        return coerce_count(F.col(name)).cast("bigint")
    if name == "comments_data":
        return records_from_json(F.col(name))
    return F.col(name).try_cast(POST_SCHEMA[name].dataType)


def to_post_schema(df: DataFrame) -> DataFrame:
    """Rename, type and order columns; a missing column becomes null (counts: 0)."""
    for old, new in RENAMED.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = [n for n in POST_COLUMNS if n not in df.columns]
    df = df.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else df
    return df.select(*[_typed(n).alias(n) for n in POST_COLUMNS])


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``header, file`` of each CSV file below ``path``: its first line that is not empty, without a byte order mark.

    One pass over the files as plain text, reduced to a row per file in each task. A file without such a line has no row. Column names with
    line breaks in them are not supported.
    """
    lines = _read(spark, path, "text").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", "^\ufeff|\r$", "")
    first = lines.where("file_block_start = 0").withColumn("value", bare).where("value <> ''")
    header = F.min_by("value", "at")
    return first.groupBy("file_path").agg(header.alias("header")).select("header", F.col("file_path").alias("file"))


def _plain_path(uri: str) -> str:
    """A file's URI as a path to read: no percent codes, pattern characters escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _text_columns(header: str) -> T.StructType:
    """Text columns under the names of a header line; an empty or repeated name gets its place behind it, as Spark's own reader does it."""
    names = next(csv.reader([header]))
    return T.StructType([T.StructField(n if n and names.count(n) == 1 else f"{n or '_c'}{i}", T.StringType()) for i, n in enumerate(names)])


def read_mixed(spark: SparkSession, path: str, most_headers: int = MOST_HEADERS) -> DataFrame:
    """CSV posts of a folder or pattern whose files differ in their headers: one reader for each header, in the canonical columns.

    The list of files comes to the driver, as it does for any reader; more headers than ``most_headers`` are an error.
    """
    groups = file_headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").limit(most_headers + 1).collect()
    if not groups:
        raise EmptySourceError(f"source holds no header: {path}")
    if len(groups) > most_headers:
        raise SchemaError(f"more than {most_headers} headers below {path}")
    frames = [to_post_schema(_read(spark, [_plain_path(f) for f in g["files"]], "csv", _text_columns(g["header"]), **CSV_OPTIONS)) for g in groups]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def read_posts(spark: SparkSession, path: str, fmt: str = "csv",
               allow_empty: bool = False, mixed: bool = False) -> DataFrame:
    """The post table at ``path`` (any file system Spark knows).

    Raises :class:`MissingSourceError` or :class:`EmptySourceError`. CSV values
    are read as text under the file's own header and then typed, so no
    inference pass runs and unreadable counts become 0. CSV files below one path
    share a header; Spark fails on another one, unless ``mixed`` asks for a reader per
    header (see ``read_mixed``). A quoted line break keeps a CSV file in one task, so
    large tables are kept as parquet.
    """
    if fmt == "csv" and mixed:
        posts = read_mixed(spark, path)
    elif fmt == "csv":
        posts = to_post_schema(_read(spark, path, "csv", **CSV_OPTIONS, **ONE_HEADER))
    else:
        posts = _read(spark, path, fmt)
    if not allow_empty and posts.isEmpty():
        raise EmptySourceError(f"source holds no rows: {path}")
    return posts


def read_drifted(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of CSV sources whose headers differ; each is read under its own header.

    A path is a file, a folder or a pattern of files that share one header, so
    name one path per header. One reader over all of them would take the first
    header for every file.
    """
    frames = [read_posts(spark, p) for p in paths]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def seen_ids(posts: DataFrame) -> DataFrame:
    """Distinct stored ids; blank ids are skipped. Reads the id column only."""
    return posts.select("video_id").where(F.col("video_id") != "").distinct()


def to_csv_columns(df: DataFrame) -> DataFrame:
    """Columns as CSV can hold them: lists, structs and maps become JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        (records_to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested)
         else F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name)
         if isinstance(f.dataType, T.TimestampType) else F.col(f.name))
        for f in df.schema
    ])


def append_posts(posts: DataFrame, path: str, fmt: str = "parquet") -> str | None:
    """Append a batch in the canonical column order; an empty batch writes nothing.

    A column outside the schema is refused. Returns the path, or None when
    nothing was written.
    """
    extra = [c for c in posts.columns if c not in POST_COLUMNS]
    missing = [c for c in POST_COLUMNS if c not in posts.columns]
    if extra or missing:
        raise SchemaError(f"cannot append: extra columns {extra}, missing columns {missing}")
    batch = posts.select(*[F.col(f.name).cast(f.dataType) for f in POST_SCHEMA])
    if batch.isEmpty():
        return None
    if fmt == "csv":
        to_csv_columns(batch).write.mode("append").options(**CSV_OPTIONS).csv(path)
    else:
        batch.write.mode("append").format(fmt).save(path)
    return path


def publish(posts: DataFrame, uri: str, fmt: str = "parquet") -> str:
    """Write the table under a fixed name, replacing what is there."""
    frame = to_csv_columns(posts) if fmt == "csv" else posts
    options = CSV_OPTIONS if fmt == "csv" else {}
    frame.write.mode("overwrite").format(fmt).options(**options).save(uri)
    return uri


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Let the pointer below ``root`` name ``version``: a new one is written whole, then takes the old one's place."""
    jvm, new, fs = _hadoop(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), how)


def published_version(spark: SparkSession, root: str) -> str | None:
    """Folder of the version that ``root`` points at, or None before the first one."""
    _, pointer, fs = _hadoop(spark, f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    return f"{root}/{spark.read.text(f'{root}/{POINTER}').head()[0]}"


def publish_version(posts: DataFrame, root: str, fmt: str = "parquet", keep: int = 2) -> str:
    """Write the table as a new version below ``root`` and point at it once it is whole; returns the version's folder.

    A job that dies, or fails, leaves the version before as it was. The ``keep`` newest versions stay, so a reader of the one
    before can end; older ones and what dead jobs left are deleted. One writer at a time.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    spark = posts.sparkSession
    root = root.rstrip("/")
    version = f"v-{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    publish(posts, f"{root}/{version}", fmt)
    before = published_version(spark, root)
    _point(spark, root, version)
    _, folder, fs = _hadoop(spark, root)
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("v-")), reverse=True)
    whole = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    stay = {version, *([before.rsplit("/", 1)[1]] if before and keep > 1 else []), *whole[:keep]}
    for name in names:
        if name not in stay:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return f"{root}/{version}"


def read_published(spark: SparkSession, root: str, fmt: str = "parquet", allow_empty: bool = False) -> DataFrame:
    """The posts of the version that ``root`` points at; raises :class:`MissingSourceError` before the first one."""
    version = published_version(spark, root.rstrip("/"))
    if version is None:
        raise MissingSourceError(f"nothing published: {root}")
    return read_posts(spark, version, fmt, allow_empty)


def export_rows(df: DataFrame, folder: str, columns: Sequence[str] | None = None,
                index: str | None = None, stamp: datetime | None = None) -> str:
    """All rows as CSV part files below a time-stamped name; returns that path.

    ``index`` names an existing row-number column (see ``with_row_index``) to
    put first.
    """
    chosen = [*([index] if index else []), *(columns or [c for c in df.columns if c != index])]
    when = (stamp or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/export_{when}"
    to_csv_columns(df.select(*chosen)).write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)
    return path
