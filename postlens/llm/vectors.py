"""Near-duplicate vectors by sorted projection passes.

Each pass draws its own random directions. A vector's hash in a pass is the row of signs of the products with them of what
sets it apart from its label's mean; vectors of one label are ordered by label and hash by a range sort over all tasks, and
each is compared with a bounded window of its neighbours. The closer a label's vectors lie together and the more there
are, the more passes it gets. Verified pairs of all passes are united into components, and each component's direct links are
then counted block against block, so a group that is larger than the window loses none of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.components import components
from postlens.llm.simhash import forest
from postlens.llm.store import keep, worker_path

BITS = 48
CHUNK = 1024
ROWS_PER_TASK = 4096
FEWEST_PASSES = 4


def sound_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v array<double>, class`` of each row; ``class`` names equal vectors of a label, and is null where nothing can link."""
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                    F.col(vector_col).cast("array<double>").alias("v"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
             & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    return raw.withColumn("class", F.when(sound, F.concat_ws("-", F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64("v", "label")))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows scaled to length one; the largest component goes first to one, so no square over- or underflows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _stars(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    label = forest(len(own), i, j)
    moved = np.flatnonzero(label != np.arange(len(own)))
    return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], ["a", "b"])


def passes_needed(n: int, likeness: float, least: float, window: int, lost: float) -> int:
    """Passes after which a pair at cosine ``least`` has met in a window but for a share ``lost``, by the model below.

    ``n`` vectors have a mean cosine of ``likeness``. Off their mean, a pair at ``least`` has the cosine 1 - (1 - least) / (1 - likeness);
    it agrees in a bit with the chance 1 - angle / pi, and has to agree in the log2(n / window) bits that leave a window's
    worth of rows. Below a cosine of 0.5 off the mean most pairs of the label link, and any window finds some.
    """
    depth = max(0.0, math.log2(max(1, n) / window))
    apart = 1 - (1 - least) / max(1e-12, 1 - likeness)
    meet = (1 - math.acos(min(1.0, max(0.5, apart))) / math.pi) ** depth
    return FEWEST_PASSES if meet >= 1 else max(FEWEST_PASSES, math.ceil(math.log(lost) / math.log1p(-meet)))


def label_centres(vectors: DataFrame, least: float, window: int, lost: float) -> DataFrame:
    """``label, size, centre, passes``: the mean of each label's vectors at length one, and the passes it needs."""
    def sums(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            labels, sizes = batch.column("label").dictionary_encode(), batch.column("size").to_numpy(zero_copy_only=False)
            codes = labels.indices.to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                of_size = sizes == size
                x, code = _matrix(batch.column("v").filter(pa.array(of_size))), codes[of_size]
                for c in np.unique(code).tolist():
                    own = x[code == c]
                    yield pa.RecordBatch.from_arrays([pa.array([labels.dictionary[c].as_py()]), pa.array([size], pa.int32()), pa.array([len(own)], pa.int64()),
                                                      pa.array([own.sum(axis=0)], pa.list_(pa.float64()))], ["label", "size", "n", "total"])

    @F.pandas_udf("int")
    def passes(n: pd.Series, likeness: pd.Series) -> pd.Series:
        return pd.Series([passes_needed(a, b, least, window, lost) for a, b in zip(n, likeness, strict=True)])

    part = vectors.select("label", "size", "v").mapInArrow(sums, "label string, size int, n long, total array<double>")
    by_place = part.select("label", "size", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "size", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    means = by_place.groupBy("label", "size").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x")))).alias("means"))
    centre = F.transform("means", lambda m: m["x"])
    likeness = F.aggregate("means", F.lit(0.0), lambda t, m: t + m["x"] * m["x"])
    return means.select("label", "size", centre.alias("centre"), passes("n", likeness).alias("passes"))


def projection_links(vectors: DataFrame, least: float, window: int, lost: float, seed: int = 11) -> DataFrame:
    """Links ``a, b`` that join the vectors of verified pairs; a task's pairs are given as stars."""

    def hashed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == size))
                centres = some.column("centre").flatten().to_numpy(zero_copy_only=False).reshape(len(some), size)
                x, passes = _matrix(some.column("v")) - centres, some.column("passes").to_numpy()
                some = some.select(["node", "label", "v", "size"])
                for k in range(passes.max()):
                    wanted = passes > k
                    rows = some if wanted.all() else some.filter(pa.array(wanted))
                    directions = np.random.default_rng([seed, k, size]).standard_normal((size, BITS))
                    signs = np.packbits((x if wanted.all() else x[wanted]) @ directions > 0, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array([s.tobytes() for s in signs], pa.binary()), *rows.columns],
                                                     ["pass", "hash", *rows.schema.names])

    fields = "pass int, hash binary, node long, label string, v array<double>, size int"
    centres = keep(label_centres(vectors, least, window, lost), "label_centres")
    ordered = vectors.join(centres, ["label", "size"]).select("node", "label", "v", "size", "centre", "passes").mapInArrow(hashed, fields) \
        .repartitionByRange("pass", "label", "size", "hash", "node").sortWithinPartitions("pass", "label", "size", "hash", "node")

    def window_pairs(groups: np.ndarray, x: np.ndarray):
        i, j = [], []
        for s in range(0, len(x), CHUNK):
            e = min(len(x), s + CHUNK)
            near = x[s:e] @ x[s:min(len(x), e + window)].T
            p, q = np.nonzero(near >= least - 1e-9)
            ok = (q > p) & (q - p <= window)
            p, q = p[ok], q[ok]
            close = np.flatnonzero(near[p, q] < least + 1e-9)
            ok = groups[p + s] == groups[q + s]
            ok[close] &= np.einsum("ij,ij->i", x[p[close] + s], x[q[close] + s]) >= least
            i.append(p[ok] + s)
            j.append(q[ok] + s)
        return np.concatenate(i), np.concatenate(j)

    def scan(batches: Iterator[pa.RecordBatch]):
        part, tail, first = TaskContext.get().partitionId(), None, True
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.float64())]
        names = ["a", "b", "edge", "side", "group", "node", "v"]

        def edge(of, boundary, side):
            n = len(of[1])
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, boundary, np.int32)), pa.array(np.full(n, side, np.int32)),
                                               pa.array(of[0], pa.string()), pa.array(of[1]), pa.array(list(of[2]), kinds[-1])], names)

        for batch in batches:
            if not len(batch):
                continue
            group = np.array([f"{k}|{s}|{x}" for k, s, x in zip(*(batch.column(c).to_pylist() for c in ("pass", "size", "label")), strict=True)], object)
            node, rows = batch.column("node").to_numpy(zero_copy_only=False), batch.column("v")
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            parts = [_matrix(rows.filter(pa.array(sizes == s))) for s in dict.fromkeys(sizes.tolist())]
            if len(parts) > 1:  # shorter vectors are filled up with zeros; groups keep the sizes apart
                wide = max(p.shape[1] for p in parts)
                parts = [np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts]
                x = np.zeros((len(node), wide))
                for s, p in zip(dict.fromkeys(sizes.tolist()), parts, strict=True):
                    x[sizes == s] = p
            else:
                x = parts[0]
            if first:
                yield edge((group[:window], node[:window], x[:window]), part - 1, 1)
                first = False
            if tail is not None:
                if tail[2].shape[1] != x.shape[1]:
                    wide = max(tail[2].shape[1], x.shape[1])
                    tail = (*tail[:2], np.pad(tail[2], ((0, 0), (0, wide - tail[2].shape[1]))))
                    x = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
                group, node, x = (np.concatenate([a, b]) for a, b in zip(tail, (group, node, x), strict=True))
            stars = _stars(node, *window_pairs(group, x))
            n = len(stars)
            yield pa.RecordBatch.from_arrays([*stars.columns, *(pa.nulls(n, k) for k in kinds[2:])], names)
            tail = (group[-window:], node[-window:], x[-window:])
        if tail is not None:
            yield edge(tail, part, 0)

    found = keep(ordered.mapInArrow(scan, "a long, b long, edge int, side int, group string, node long, v array<double>"), "window_links")

    def join_edge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side", kind="stable").reset_index(drop=True)
        left = int((pdf["side"] == 0).sum())
        wide = max(map(len, pdf["v"]))
        x = np.stack([np.pad(np.asarray(v), (0, wide - len(v))) for v in pdf["v"]])
        near = x[:left] @ x[left:].T
        i, j = np.nonzero(near >= least)
        group = pdf["group"].to_numpy()
        ok = (left - i + j <= window) & (group[i] == group[j + left])
        stars = _stars(pdf["node"].to_numpy(), i[ok], j[ok] + left)
        return stars.to_pandas()

    # A task's last and first rows: at most twice the window for each boundary between tasks.
    edges = found.where("edge is not null").groupBy("edge").applyInPandas(join_edge, "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(edges)


def count_links(grouped: DataFrame, least: float) -> DataFrame:
    """``class, n`` for ``grouped(class, component, v, copies)``: the copies of the other classes of its component at ``least`` or more.

    Components larger than a chunk are dealt over a grid of chunk pairs; smaller ones share tasks.
    """
    sizes = keep(grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component_sizes")
    some = sizes.agg(F.sum("members")).head()[0] or 0
    tasks = max(1, -(-some // ROWS_PER_TASK))
    chunks = F.ceil(F.col("members") / F.lit(CHUNK)).cast("int")
    placed = grouped.join(sizes, "component").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "class", "component", "v", "copies", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")).alias("deal"),
        (F.col("chunks") == 1).alias("small"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        names, counts = [], []
        for _, g in pdf.groupby("component", sort=False):
            lengths = g["v"].map(len).to_numpy()
            for size in np.unique(lengths).tolist():
                same = g[lengths == size]
                x = _matrix(pa.array(same["v"].tolist(), pa.list_(pa.float64())))
                own = same["own"].to_numpy()
                linked = x @ x.T >= least
                np.fill_diagonal(linked, False)
                if same["i"].iloc[0] != same["j"].iloc[0]:
                    linked &= own[:, None] != own[None, :]
                names.append(same["class"].to_numpy())
                counts.append(linked @ same["copies"].to_numpy())
        return pd.DataFrame({"class": np.concatenate(names), "n": np.concatenate(counts)})

    return cells.groupBy("small", "deal", "i", "j").applyInPandas(cell, "class string, n long").groupBy("class").agg(F.sum("n").alias("n"))


def near_vectors(df: DataFrame, least: float = 0.98, window: int = 512, lost: float = 1e-4, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: near-duplicate vectors of one label by cosine.

    Vectors that are null, empty, zero or hold a null or non-finite component, and those whose label or id is null, link
    with nothing: no links, their own id as component, kept. Vectors of different sizes do not link. Ids are integers;
    equal vectors of a label are one class, whose rows are linked to each other; rows that repeat an id count as further
    vectors and share a component. ``lost`` is the share of pairs at ``least`` that no pass may bring within ``window`` rows, by the
    model of ``passes_needed``. An empty table gives no rows.
    """
    worker_path(df.sparkSession)
    rows = keep(sound_vectors(df, id_col, vector_col, label_col), "vectors")
    classes = keep(rows.where("class is not null").groupBy("class").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "vector_classes")
    links = projection_links(classes.withColumn("size", F.size("v")), least, window, lost)
    copies = rows.where("class is not null").select("vec_id", "class").join(classes.select("class", "node"), "class") \
        .where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    tree = keep(components(links.unionByName(copies)), "vector_components")
    grouped = keep(classes.join(tree, "node", "left").withColumn("component", F.coalesce("component", "node")), "linked_classes")
    several = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("component")
    counts = count_links(grouped.join(several, "component").select("class", "component", "v", "copies"), least)
    of_class = keep(grouped.join(counts, "class", "left").select("class", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "class_links")
    return rows.select("vec_id", "class").join(of_class, "class", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))
