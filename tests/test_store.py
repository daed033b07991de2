"""Sources, sinks, raw pages and ingest."""

import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postlens.operators.dedup import ingest_summary, new_posts_only, sample_new_posts, seen_after_batch
from postlens.operators.ranking import with_row_index
from postlens.schema import POST_COLUMNS, POST_SCHEMA, EmptySourceError, MissingSourceError, SchemaError
from postlens.session import ConfigError, shared_root
from postlens.sources import posts as src
from postlens.sources.pages import ExtractionRule, pages_to_posts, with_metrics
from postlens.streaming.ingest import drop_repeats_within, read_store, start_ingest

HEADER_SHARES = "video_id,video_url,caption,likes,comments,shares,comment_text,timestamp\n"
HEADER_SAVES = "video_id,video_url,caption,likes,comments,saves,comment_text,timestamp\n"


def make_posts(spark, ids, caption="a caption"):
    frame = spark.createDataFrame([(i,) for i in ids], "video_id string")
    return src.to_post_schema(frame.withColumns({"caption": F.lit(caption), "comments": F.lit("4")}))


def test_drifted_headers(spark, tmp_path):
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text(HEADER_SHARES + '007,u1,"a, ""quoted""\nsecond line",1,2,3,,2025-06-26T17:21:26.068345\n'
                     + "8,u2,plain,x,,5,one ||| two,2025-06-26T17:21:27.000001\n", encoding="utf8")
    second.write_text(HEADER_SAVES + "007,u1,again,0,3.0,9,,2025-06-26T17:21:28.000001\n", encoding="utf8")
    posts = src.read_drifted(spark, [str(first), str(second)])
    assert posts.columns == POST_COLUMNS and posts.schema == POST_SCHEMA
    rows = posts.orderBy("timestamp").collect()
    assert rows[0]["video_id"] == "007" and rows[0]["caption"] == 'a, "quoted"\nsecond line'
    assert [r["saves"] for r in rows] == [3, 5, 9]
    assert [(r["likes"], r["comments"]) for r in rows] == [(1, 2), (0, 0), (0, 3)]
    assert rows[0]["comment_text"] is None and str(rows[0]["timestamp"]) == "2025-06-26 17:21:26.068345"
    assert src.seen_ids(posts).count() == 2


def test_source_errors(spark, tmp_path):
    with pytest.raises(MissingSourceError):
        src.read_posts(spark, str(tmp_path / "none.csv"))
    (tmp_path / "header.csv").write_text(HEADER_SAVES)
    with pytest.raises(EmptySourceError):
        src.read_posts(spark, str(tmp_path / "header.csv"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(EmptySourceError):
        src.read_posts(spark, str(tmp_path / "empty"), "parquet")
    assert src.read_posts(spark, str(tmp_path / "header.csv"), allow_empty=True).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_append(spark, tmp_path, fmt):
    store = str(tmp_path / "store")
    assert src.append_posts(make_posts(spark, []), store, fmt) is None
    assert not glob.glob(store)
    assert src.append_posts(make_posts(spark, ["1", "2"], 'x, "y"\nz'), store, fmt) == store
    src.append_posts(make_posts(spark, ["3"]), store, fmt)
    back = src.read_posts(spark, store, fmt)
    assert back.columns == POST_COLUMNS and back.count() == 3
    assert {r["caption"] for r in back.collect()} == {'x, "y"\nz', "a caption"}
    with pytest.raises(SchemaError):
        src.append_posts(make_posts(spark, ["4"]).withColumnRenamed("saves", "shares"), store, fmt)


def test_comment_records_survive_csv(spark, tmp_path):
    records = F.array(F.struct(F.lit('said "hi"\nthere').alias("text"),
                               F.lit("2024-01-02 03:04:05").cast("timestamp").alias("extracted_at")))
    posts = make_posts(spark, ["1"]).withColumn("comments_data", records)
    path = src.publish(posts, str(tmp_path / "out"), "csv")
    src.publish(posts, path, "csv")  # publishing again replaces
    (row,) = src.read_posts(spark, path).collect()
    assert row["comments_data"][0]["text"] == 'said "hi"\nthere'
    assert str(row["comments_data"][0]["extracted_at"]) == "2024-01-02 03:04:05"


def test_export(spark, tmp_path):
    frame = with_row_index(spark.range(50).withColumn("caption", F.lit("a,b")), F.desc("id"))
    path = src.export_rows(frame, str(tmp_path), ["id"], "row_index", datetime(2025, 6, 26, 16, 42, 30))
    assert path.endswith("export_20250626_164230")
    back = spark.read.options(**src.CSV_OPTIONS).csv(path)
    assert back.columns == ["row_index", "id"] and back.count() == 50
    assert back.where("row_index = 0").first()["id"] == "49"


PAGE = """<html><div data-e2e="browse-video-desc"><span>My <b>caption</b> &amp; more</span></div>
<strong data-e2e="like-count">1.2K</strong><span title="34 comments"></span>
<strong>7</strong><strong> 8M </strong><strong>9</strong><strong>x</strong></html>"""


def test_default_page_rules(spark):
    pages = spark.createDataFrame([(1, "https://h/@u/video/55?x", PAGE), (2, "https://h/none", PAGE)],
                                  "page_id int, url string, html string")
    (row,) = pages_to_posts(pages).collect()
    assert row["video_id"] == "55" and row["caption"] == "My caption & more"
    assert (row["likes"], row["comments"]) == (1200, 34)
    assert row["saves"] == 9 and row["metrics_source"] == "position"


def test_page_comments(spark):
    def block(inner):
        return f'<div data-e2e="comment-level-1">{inner}</div>'

    html = "".join([
        block("<span>@user</span><span>a long enough comment</span><span>3d</span>"),
        block("<p>@user</p><br>12K<br>whole text as a fallback"),
        block("<span>a long enough comment</span>"), block("<span>too short</span>"),
        *[block(f"<span>comment with number {i}</span>") for i in range(25)],
    ])
    pages = spark.createDataFrame([("https://h/video/1", html), ("https://h/video/2", "")], "url string, html string")
    one, two = pages_to_posts(pages).orderBy("video_id").collect()
    texts = ["a long enough comment", "whole text as a fallback", *[f"comment with number {i}" for i in range(25)]]
    assert one["comment_text"] == " ||| ".join(texts) and one["comment_count_extracted"] == 27
    assert [c["text"] for c in one["comments_data"]] == texts
    assert two["comment_text"] == "" and two["comments_data"] == []


def test_nested_elements(spark):
    html = (
        '<div data-e2e="browse-video-desc"><div>gta 6</div> trailer <div>second <br/>part</div></div><div>other</div>'
        '<svg width="1"></svg><svg fill="#FE2C55"><path d=""/></svg> <strong>1.2K</strong><strong>7</strong>'
        '<div data-e2e="comment-x">9</div><strong data-e2e="comment-x">34</strong>'
        '<div data-e2e="comment-level-1"><div>@user</div><div><div>a comment in inner blocks</div></div></div>'
        '<div data-e2e="comment-level-1"><span>short <span>and a longer</span> piece of text</span><span>small one here</span></div>')
    pages = spark.createDataFrame([("https://h/video/1", html), ("https://h/video/2", '<div data-e2e="video-desc">open <b>end')], "url string, html string")
    one, two = pages_to_posts(pages).orderBy("video_id").collect()
    assert one["caption"] == "gta 6 trailer second part" and (one["likes"], one["comments"]) == (1200, 34)
    assert one["comment_text"] == "a comment in inner blocks ||| short and a longer piece of text"
    assert two["caption"] == "open end"


def test_drifting_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("video_id,caption,shares\n1,x,30\n")
    (folder / "b.csv").write_text("video_id,caption,likes\n2,y,40\n")
    with pytest.raises(Exception, match="(?i)header"):
        src.read_posts(spark, str(folder)).collect()
    both = src.read_drifted(spark, [str(folder / "a.csv"), str(folder / "b.csv")]).orderBy("video_id").collect()
    assert [(r["saves"], r["likes"]) for r in both] == [(30, 0), (0, 40)]


def test_mixed_headers_are_found(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a [1].csv").write_text('video_id,caption,shares\n1,"x\nvideo_id,caption,saves",30\n')
    (folder / "b%20c.csv").write_text("\n\nsaves,video_id,,x,x\n40,2,,,\n", encoding="utf8")
    (folder / "c.csv").write_text("saves,video_id\r\n41,3\r\n", encoding="utf8")
    (folder / "d.csv").write_text("\ufeffvideo_id,caption,shares\n4,y,50\n", encoding="utf8")
    (folder / "header.csv").write_text("likes,video_id\n")
    (folder / "none.csv").write_text("")
    headers = [r["header"] for r in src.file_headers(spark, str(folder)).collect()]
    assert sorted(headers) == ["likes,video_id", "saves,video_id", "saves,video_id,,x,x"] + ["video_id,caption,shares"] * 2
    posts = src.read_posts(spark, str(folder), mixed=True)
    assert posts.schema == POST_SCHEMA
    assert [(r["video_id"], r["caption"], r["saves"]) for r in posts.orderBy("video_id").collect()] == [
        ("1", "x\nvideo_id,caption,saves", 30), ("2", None, 40), ("3", None, 41), ("4", "y", 50)]
    with pytest.raises(SchemaError):
        src.read_mixed(spark, str(folder), most_headers=2)
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "e.csv").write_text("\n")
    with pytest.raises(EmptySourceError):
        src.read_posts(spark, str(tmp_path / "blank"), mixed=True)
    with pytest.raises(MissingSourceError):
        src.read_posts(spark, str(tmp_path / "nowhere"), mixed=True)


def test_a_failed_publish_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(MissingSourceError):
        src.read_published(spark, root)

    def ids():
        return sorted(r["video_id"] for r in src.read_published(spark, root).collect())

    first = src.publish_version(make_posts(spark, ["a", "b"]), root)
    reader = src.read_published(spark, root)
    broken = make_posts(spark, ["c", "d"]).withColumn("caption", F.when(F.col("video_id") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("caption")))
    with pytest.raises(Exception, match="lost"):
        src.publish_version(broken, root)
    assert ids() == ["a", "b"] and src.published_version(spark, root) == first
    src.publish_version(make_posts(spark, ["e"]), root)
    assert ids() == ["e"] and reader.count() == 2  # the version before is still there
    last = src.publish_version(make_posts(spark, ["f"]), root + "/")
    assert ids() == ["f"] and src.published_version(spark, root) == last
    assert len(glob.glob(f"{root}/v-*")) == 2 and first not in glob.glob(f"{root}/v-*")


def test_positional_fallback(spark):
    pages = spark.createDataFrame([
        ("<strong>1</strong><strong>2K</strong><strong>3</strong>", ""),
        ("likes(50) <strong>1</strong><strong>2K</strong><strong>3</strong>", ""),
        ("likes(50)", ""),
    ], "html string, url string")
    rules = [ExtractionRule("likes", 0, r"likes\((\d+)\)")]
    rows = with_metrics(pages, rules).select("likes", "comments", "saves", "metrics_source").collect()
    assert [tuple(r) for r in rows] == [(1, 2000, 3, "position"), (50, 2000, 3, "position"), (50, 0, 0, "rule")]


def test_new_posts(spark):
    incoming = spark.createDataFrame(
        [("a", 3), ("a", 1), ("b", 2), ("c", 5)] + [("hot", i) for i in range(500)], "video_id string, n int")
    seen = spark.createDataFrame([("b",), ("b",)], "video_id string")
    fresh = new_posts_only(incoming, seen, "n")
    assert sorted(map(tuple, fresh.collect())) == [("a", 1), ("c", 5), ("hot", 0)]
    assert {r[0] for r in seen_after_batch(seen, fresh).collect()} == {"a", "b", "c", "hot"}
    many = spark.range(1000).select(F.col("id").cast("string").alias("video_id"))
    one, two = (sample_new_posts(many, seen, 10, seed=1).collect() for _ in range(2))
    assert one == two and len({r[0] for r in one}) == 10
    assert sample_new_posts(many, seen, 10, seed=2).collect() != one
    total = ingest_summary(incoming).first()
    assert (total["total_rows"], total["distinct_posts"]) == (504, 4)


RULES = [ExtractionRule("caption", 0, r"<h1>(.*?)</h1>")]


def page_rows(spark, rows):
    return spark.createDataFrame(
        [(i, f"https://h/{key}", f"<h1>{cap}</h1>") for i, key, cap in rows],
        "page_id int, url string, html string").coalesce(1)


def to_posts(pages):
    return pages_to_posts(pages, RULES, [], None, r"/(\d+)$", keep=("page_id",))


def ingest(spark, pages_dir, store, checkpoint, run):
    stream = (spark.readStream.schema("page_id int, url string, html string")
              .option("maxFilesPerTrigger", 1).parquet(str(pages_dir)))
    query = start_ingest(stream, to_posts, str(store), str(checkpoint), run, ["keep"], ("page_id",))
    query.awaitTermination()
    return query


def test_stream_ingest(spark, tmp_path):
    pages, store, check = tmp_path / "pages", tmp_path / "store", tmp_path / "check"
    page_rows(spark, [(1, "1", "keep a"), (2, "1", "keep copy"), (3, "2", "drop"), (4, "3", "keep c")]).write.mode("append").parquet(str(pages))
    ingest(spark, pages, store, check, "r1")
    stored = lambda: sorted((r["video_id"], r["caption"]) for r in read_store(spark, str(store)).collect())
    assert stored() == [("1", "keep a"), ("3", "keep c")]
    page_rows(spark, [(5, "3", "keep again"), (6, "4", "keep d")]).write.mode("append").parquet(str(pages))
    page_rows(spark, [(7, "5", "nothing")]).write.mode("append").parquet(str(pages))
    ingest(spark, pages, store, check, "r1")  # goes on where it stopped
    assert stored() == [("1", "keep a"), ("3", "keep c"), ("4", "keep d")]
    ingest(spark, pages, store, tmp_path / "other", "r2")  # a full second pass adds nothing
    assert stored() == [("1", "keep a"), ("3", "keep c"), ("4", "keep d")]


def test_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    from postlens.streaming.ingest import write_batch
    store = str(tmp_path / "store")
    batch = to_posts(page_rows(spark, [(1, "1", "keep a"), (2, "2", "keep b")]))
    for _ in range(2):
        write_batch(batch, store, "r", 0, ("page_id",))
    write_batch(to_posts(page_rows(spark, [(3, "2", "keep x"), (4, "3", "keep y")])), store, "r", 1, ("page_id",))
    rows = sorted((r["video_id"], r["caption"], r["ingest_batch"]) for r in read_store(spark, store).collect())
    assert rows == [("1", "keep a", 0), ("2", "keep b", 0), ("3", "keep y", 1)]
    assert read_store(spark, str(tmp_path / "none")).count() == 0


def test_bounded_state_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:06:00")],
                                 "video_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = drop_repeats_within(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 hour")
    query = (stream.writeStream.format("memory").queryName("unique_posts").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r[0] for r in spark.sql("select video_id from unique_posts").collect()) == ["a", "b"]


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class _Session:
    class sparkContext:  # noqa: N801
        master = "yarn"

    def __init__(self, value):
        self.conf = _Conf(value)


def test_work_is_discarded(spark, tmp_path, monkeypatch):
    from postlens import session
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    kept = session.materialized(spark.range(3), "numbers")
    assert kept.count() == 3 and glob.glob(f"{tmp_path}/postlens/*/numbers-*")
    session.discard_work(spark)
    assert not glob.glob(f"{tmp_path}/postlens/*")


def test_shared_folder_comes_from_the_session():
    assert shared_root(_Session("hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(ConfigError):
        shared_root(_Session(None))


def test_work_scope_frees_its_copies(spark):
    import os

    from postlens.session import materialized, work_path, work_scope

    kept = materialized(spark.range(3), "outer")
    with work_scope(spark):
        inner = materialized(spark.range(5), "inner")
        folder = os.path.dirname(work_path(spark, "x"))
        assert inner.count() == 5
    names = os.listdir(folder.removeprefix("file:"))
    assert kept.count() == 3 and any(n.startswith("outer-") for n in names) and not any(n.startswith("inner-") for n in names)


def test_batch_reads_its_id_buckets_only(spark, tmp_path):
    from postlens.streaming.ingest import index_store, stored_ids, write_batch

    store = str(tmp_path / "store")
    posts = src.to_post_schema(spark.range(200).select(F.col("id").cast("string").alias("video_id"), F.lit("c").alias("caption")))
    write_batch(posts, store, "r", 0)
    bucket = posts.where("video_id = '17'").select(F.pmod(F.xxhash64("video_id"), F.lit(16))).first()[0]
    read = stored_ids(spark, store, [bucket])
    assert {f.split("id_bucket=")[1].split("/")[0] for f in read.inputFiles()} == {str(bucket)}
    assert 0 < read.count() < 200 and "17" in {r["video_id"] for r in read.collect()}
    write_batch(posts.where("video_id = '17'").unionByName(posts.limit(1).withColumn("video_id", F.lit("new"))), store, "r", 1)
    assert read_store(spark, store).where("ingest_batch = 1").select("video_id").first()[0] == "new"
    before = stored_ids(spark, store, range(16)).count()
    index_store(spark, store)
    assert stored_ids(spark, store, range(16)).count() == before == 201


def _batches(spark, store, limit):
    from postlens.streaming import ingest as I

    counts = []
    for n in range(3):
        I.write_batch(make_posts(spark, [f"id{i}" for i in range(n * 75, n * 75 + 60 + 75 * (n < 2))]), store, "r", n, ids_in_bucket=limit)
        counts.append(I.id_buckets(spark, store))
    return counts


def test_id_table_grows_by_splitting(spark, tmp_path):
    from postlens.streaming import ingest as I

    store = str(tmp_path / "store")
    assert I.id_buckets(spark, store) == 0
    counts = _batches(spark, store, 3)
    assert counts == [64, 128, 128]  # 135, 210 and 210 ids
    assert sorted(r.video_id for r in read_store(spark, store).collect()) == sorted(f"id{i}" for i in range(210))
    ids = I.stored_ids(spark, store, range(128))
    assert ids.count() == 210 and {p.name for p in (tmp_path / "store_ids").iterdir() if p.is_dir()} == {"buckets=128"}
    # A batch opens the files of its own buckets and no others.
    bucket = spark.createDataFrame([("id7",)], "video_id string").select(I._bucket(128)).first()[0]
    files = I.stored_ids(spark, store, [bucket]).inputFiles()
    assert 0 < len(files) < len(ids.inputFiles()) and all(f"/id_bucket={bucket}/" in f for f in files)


def test_broken_off_split_leaves_the_old_table(spark, tmp_path):
    from postlens.streaming import ingest as I

    store = str(tmp_path / "store")
    _batches(spark, store, 10**6)
    (tmp_path / "store_ids" / "buckets=64").mkdir()
    assert I.id_buckets(spark, store) == 16 and I.stored_ids(spark, store, range(16)).count() == 210
    I.write_batch(make_posts(spark, ["id5", "new"]), store, "r", 9)
    assert read_store(spark, store).count() == 211
    assert I.index_store(spark, store, 64) == 64 and I.id_buckets(spark, store) == 64
    I.write_batch(make_posts(spark, ["id5", "new", "newer"]), store, "r", 10)
    assert read_store(spark, store).count() == 212


def test_observed_counters_and_sketches(spark, tmp_path):
    from postlens.operators.dedup import estimated_distinct, id_sketches
    from postlens.streaming import ingest as I

    store = str(tmp_path / "store")
    assert I.observed_counters(spark, store, "r").first().asDict() == {"taken_in_run": 0, "total_rows": 0, "distinct_posts": 0}
    assert estimated_distinct(I.read_counts(spark, store)).first().asDict() == {"estimate": 0, "low": 0, "high": 0}
    _batches(spark, store, 10**6)
    I.write_batch(make_posts(spark, ["id209", "id210"]), store, "r", 2)  # batch 2 again, with other posts: its folder is replaced
    I.write_batch(make_posts(spark, ["x1", "x2", "id3"]), store, "other", 0)
    for run in ("r", "other", "none"):
        assert I.observed_counters(spark, store, run).collect() == I.run_counters(spark, store, run).collect()
    files = I.observed_counters(spark, store, "r").inputFiles()
    assert len(files) == 4 and all("/store_counts/" in f for f in files)  # a short file for each batch, none with posts
    bounds = estimated_distinct(I.read_counts(spark, store)).first()
    assert bounds.low <= read_store(spark, store).count() <= bounds.high
    many = spark.range(200_000).selectExpr("cast(id as string) as video_id", "id % 7 as part", "if(id % 2 = 0, null, 1) as x")
    bounds = estimated_distinct(id_sketches(many.union(many), "part")).first()
    assert bounds.low <= 200_000 <= bounds.high and bounds.high - bounds.low < 0.09 * 200_000
    assert estimated_distinct(id_sketches(many.where("false"), "part")).first().estimate == 0
