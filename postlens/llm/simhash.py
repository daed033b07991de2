"""SimHash near-duplicates by a hierarchical index in Gray order.

Distinct fingerprints only are indexed. For each of a few masks the fingerprints are sorted by the bits under the mask
and then by the Gray rank of the rest, by a range sort over all tasks. The index's upper nodes are the runs that share the
bits under a mask; below them, blocks of neighbours in Gray order hold the bits that all of them share, and blocks of
blocks likewise. Two nodes are compared by the bits in which all fingerprints of one differ from all of the other: a
lower bound that adds up over words, and prunes whole groups. Runs that reach over a task's edge are compared block by
block with those of other tasks, by the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.components import components
from postlens.llm.store import forget, keep, texts

LEAF = 32
SHORT = 64
BLOCK = 1024
HASHES = 1 << 15
#: Where a run has more close pairs for a fingerprint than this, they are compared in cells and not listed.
LISTED = 4
CELL = 256
CELL_ROWS = 4096


def text_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words; of all words if there are fewer."""
    words = text.encode().lower().split()
    n = len(words)
    if n <= shingle:
        joined = [b" ".join(words)] if n else []
    else:
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64)


def majority(hashes: np.ndarray, words: int) -> bytes:
    """Fingerprint of ``words`` 64-bit words: the bits set in over half of the hashes. Words after the first are of remixed hashes."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for s in range(0, len(hashes), HASHES):
            h = hashes[s:s + HASHES]
            if k:  # an avalanche of the hash and the word's number
                h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, shingle: int = 5, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp binary`` of each row. A null text is empty; without words all bits are zero."""
    source = texts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = [majority(text_hashes(t.as_py(), shingle), bits // 64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp binary")


def exact_masks(bits: int, differences: int) -> list[list[int]]:
    """One mask more than differences, over distinct bits: fingerprints so close agree under one of them."""
    cuts = [bits * k // (differences + 1) for k in range(differences + 2)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def random_masks(bits: int, width: int, count: int, seed: int = 7) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, width, replace=False).tolist()) for _ in range(count)]


def differences_at(similarity: float, bits: int) -> int:
    """Differing bits to expect of two sets of equal size with this Jaccard similarity."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def gray_rank(rows: np.ndarray) -> np.ndarray:
    """Place of each row of bits in the order of the reflected Gray code, as bits."""
    return np.bitwise_xor.accumulate(rows, axis=1)


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)


def _close(x: np.ndarray, y: np.ndarray, differences: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= differences


def _nodes(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that all (``low``) and that any (``high``) of each ``size`` neighbours have."""
    cuts = np.arange(0, len(low), size)
    return np.bitwise_and.reduceat(low, cuts, axis=0), np.bitwise_or.reduceat(high, cuts, axis=0)


def _apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Bits that are set in all of one node and in none of the other: a lower bound of the differences."""
    return np.bitwise_count((low_a & ~high_b) | (low_b & ~high_a)).sum(axis=-1, dtype=np.int64)


def close_pairs(x: np.ndarray, y: np.ndarray | None, differences: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices of rows of ``x`` and ``y`` (or of ``x`` twice, i < j) within ``differences``, with these, top down through both trees.

    They come in parts of bounded size, so a large group's pairs are never all in memory.
    """
    alone, y = y is None, x if y is None else y
    levels = [(x, x)], [(y, y)]
    for tree in levels:
        while len(tree[-1][0]) > LEAF:
            tree.append(_nodes(*tree[-1], LEAF))
    depth = max(map(len, levels))
    for tree in levels:
        while len(tree) < depth:
            tree.append(_nodes(*tree[-1], LEAF))
    na, nb = len(levels[0][-1][0]), len(levels[1][-1][0])
    i, j = (v.ravel() for v in np.meshgrid(np.arange(na), np.arange(nb), indexing="ij"))
    stack = [(depth - 1, i, j)]
    while stack:
        level, i, j = stack.pop()
        if alone:
            up = i <= j if level else i < j
            i, j = i[up], j[up]
        (la, ha), (lb, hb) = levels[0][level], levels[1][level]
        apart = _apart(la[i], ha[i], lb[j], hb[j])
        near = apart <= differences
        i, j = i[near], j[near]
        if level == 0:
            yield i, j, apart[near]
            continue
        ca, cb = len(levels[0][level - 1][0]), len(levels[1][level - 1][0])
        step = np.arange(LEAF)
        for s in range(0, len(i), 256):  # bounds the pairs in memory
            p = (i[s:s + 256, None] * LEAF + step)[:, :, None] + np.zeros(LEAF, np.int64)
            q = (j[s:s + 256, None] * LEAF + step)[:, None, :] + np.zeros((LEAF, 1), np.int64)
            ok = (p < ca) & (q < cb)
            stack.append((level - 1, p[ok], q[ok]))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _tree_links(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """At most one link from each of ``n`` nodes to the smallest that it reaches."""
    label = np.arange(n)
    for i, j, _ in pairs:
        a, b = label[i], label[j]
        new = a != b
        label = forest(n, a[new], b[new])[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _listed_links(runs: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of rows with these sorted ``runs``, and the rows whose pairs they do not list.

    All pairs of a run with at most ``LISTED`` for a row; of another the links of ``_tree_links``, and its paired rows.
    """
    n = len(runs)
    sizes, counts, some = np.bincount(runs), np.zeros(runs[-1] + 1 if n else 0, np.int64), []
    label, best, paired = np.arange(n), np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool)
    for i, j, d in pairs:
        counts += np.bincount(runs[i], minlength=len(counts))
        paired[i] = paired[j] = True
        listed = (counts <= LISTED * sizes)[runs]
        some = [(a[listed[a]], b[listed[a]]) for a, b in [*some, (i, j)] if listed[a].any()]
        np.minimum.at(best, i, (d << 32) | j)
        np.minimum.at(best, j, (d << 32) | i)
        a, b = label[i], label[j]
        new = a != b
        label = forest(n, a[new], b[new])[label]
    dense = paired & (counts > LISTED * sizes)[runs]
    moved, near = np.flatnonzero(dense & (label != np.arange(n))), np.flatnonzero(dense)
    a = np.concatenate([moved, near, *(a for a, _ in some)])
    b = np.concatenate([label[moved], best[near] & 0xFFFFFFFF, *(b for _, b in some)])
    return a, b, near


def _run_keys(mask: pa.Array, pattern: pa.Array) -> np.ndarray:
    """Mask number and masked bits as one number; they sort as the rows do."""
    rows = np.frombuffer(b"".join(pattern.to_pylist()), np.uint8).reshape(len(pattern), -1)
    key = mask.to_numpy(zero_copy_only=False).astype(np.uint64)
    for k in range(rows.shape[1]):
        key = (key << np.uint64(8)) | rows[:, k]
    return key


def _short_runs(x: np.ndarray, starts: np.ndarray, stops: np.ndarray, differences: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs within ``differences`` in all runs of 2 to ``SHORT`` rows at once, by their distance in the order."""
    short = stops - starts <= SHORT
    stop = np.repeat(np.where(short, stops, starts), stops - starts)
    i = np.arange(len(x))
    for step in range(1, SHORT):
        i = i[i + step < stop[i]]
        if not len(i):
            return
        d = np.bitwise_count(x[i] ^ x[i + step]).sum(axis=-1, dtype=np.int64)
        near = d <= differences
        yield i[near], i[near] + step, d[near]


def _ordered(fps: DataFrame, masks: list[list[int]], bits: int) -> DataFrame:
    """``mask, pattern, node, fp`` for each mask, in the order of the index over all tasks."""
    if any(len(mask) > 40 for mask in masks):
        raise ValueError("a mask has at most 40 bits")
    orders = [mask + [b for b in range(bits) if b not in set(mask)] for mask in masks]

    def key(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, bits // 8), axis=1)
            for m, (mask, order) in enumerate(zip(masks, orders, strict=True)):
                turned = rows[:, order]
                pattern = np.packbits(turned[:, :len(mask)], axis=1)
                rank = np.packbits(gray_rank(turned[:, len(mask):])[:, :64], axis=1)  # enough to bring neighbours together
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m, np.int32)), pa.array([r.tobytes() for r in pattern], pa.binary()),
                                                  pa.array([r.tobytes() for r in rank], pa.binary()), *batch.columns],
                                                 ["mask", "pattern", "rank", "node", "fp"])

    keyed = fps.select("node", "fp").mapInArrow(key, "mask int, pattern binary, rank binary, node long, fp binary")
    return keyed.repartitionByRange("mask", "pattern", "rank").sortWithinPartitions("mask", "pattern", "rank").drop("rank")


def _whole_runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    """Run keys, nodes, fingerprints, and starts and stops of a task's runs; a run's rows stay together. Also whether it is the last part."""
    at, nodes, x = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, bits // 64), np.uint64)
    batches, done = iter(batches), False
    while not done:
        batch = next(batches, None)
        if batch is None:
            done = True
        elif len(batch):
            at = np.concatenate([at, _run_keys(batch.column(0), batch.column(1))])
            nodes = np.concatenate([nodes, batch.column(2).to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, _words(batch.column(3).to_pylist())])
        if not len(at):
            continue
        starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        stops = np.append(starts[1:], len(at))
        if not done and len(starts) == 1:
            continue
        if not done:  # the last run may go on
            starts, stops = starts[:-1], stops[:-1]
        over = int(stops[-1])
        yield at[:over], nodes[:over], x[:over], starts, stops, done
        at, nodes, x = at[over:], nodes[over:], x[over:]


def fingerprint_links(fps: DataFrame, masks: list[list[int]], differences: int) -> DataFrame:
    """Links ``a, b`` that join ``fps(node long, fp binary)`` into the components of all pairs within ``differences``
    that agree under one of the masks. ``fp`` is unique. With ``exact_masks`` that is every pair.

    A group of n close fingerprints gives at most n - 1 links for each mask and task.
    """
    bits = 8 * int(fps.select(F.octet_length("fp")).head()[0]) if not fps.isEmpty() else 64
    ordered = _ordered(fps, masks, bits)

    def index(batches: Iterator[pa.RecordBatch]):
        part, block, first = TaskContext.get().partitionId(), 0, True

        def rows(links, blocks):
            return pa.RecordBatch.from_pydict({
                "a": pa.array([x[0] for x in links] + [None] * len(blocks), pa.int64()), "b": pa.array([x[1] for x in links] + [None] * len(blocks), pa.int64()),
                **{name: pa.array([None] * len(links) + [x[k] for x in blocks], kind)
                   for k, (name, kind) in enumerate((("key", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
                                                     ("nodes", pa.list_(pa.int64())), ("fps", pa.binary())))}})

        for at, nodes, x, starts, stops, done in _whole_runs(batches, bits):
            sizes = stops - starts
            i, j = _tree_links(len(at), _short_runs(x, starts, stops, differences))
            links, blocks = list(zip(nodes[i].tolist(), nodes[j].tolist(), strict=True)), []
            for k in np.flatnonzero(sizes > SHORT).tolist():
                s, e = int(starts[k]), int(stops[k])
                i, j = _tree_links(e - s, close_pairs(x[s:e], None, differences))
                links += zip(nodes[s + i].tolist(), nodes[s + j].tolist(), strict=True)
            for k in sorted(({0} if first else set()) | ({len(starts) - 1} if done else set())):
                for c in range(int(starts[k]), int(stops[k]), BLOCK):
                    some = slice(c, min(c + BLOCK, int(stops[k])))
                    low, high = np.bitwise_and.reduce(x[some]), np.bitwise_or.reduce(x[some])
                    blocks.append((int(at[starts[k]]), part, block, low.tobytes(), high.tobytes(), nodes[some].tolist(), x[some].tobytes()))
                    block += 1
            first = False
            yield rows(links, blocks)

    found = keep(ordered.mapInArrow(index, "a long, b long, key long, part int, block int, low binary, high binary, nodes array<long>, fps binary"), "index")
    heads = found.where("key is not null").select("key", "part", "block", "low", "high")
    left, right = (heads.select(*(F.col(c).alias(c + s) for c in heads.columns)) for s in "xy")

    def bounded(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if len(batch):
                la, ha, lb, hb = (_words(batch.column(c).to_pylist()) for c in ("lowx", "highx", "lowy", "highy"))
                near = pa.array(_apart(la, ha, lb, hb) <= differences)
                yield batch.select(["partx", "blockx", "party", "blocky"]).filter(near)

    # Written, as a task that runs both functions has two worker processes, which then stay and fill up for later stages.
    meet = keep(left.join(right, (F.col("keyx") == F.col("keyy")) & (F.col("partx") < F.col("party"))).mapInArrow(
        bounded, "partx int, blockx int, party int, blocky int"), "meeting_blocks")
    payload = found.where("key is not null").select("part", "block", "nodes", "fps")
    full = meet.join(payload.select(F.col("part").alias("partx"), F.col("block").alias("blockx"), F.col("nodes").alias("nx"), F.col("fps").alias("fx")), ["partx", "blockx"]) \
        .join(payload.select(F.col("part").alias("party"), F.col("block").alias("blocky"), F.col("nodes").alias("ny"), F.col("fps").alias("fy")), ["party", "blocky"])

    def across(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                nx, ny = np.array(row["nx"]), np.array(row["ny"])
                x, y = (np.frombuffer(row[f], np.uint64).reshape(len(n), -1) for f, n in (("fx", nx), ("fy", ny)))
                pairs = ((i, j + len(nx), d) for i, j, d in close_pairs(x, y, differences))
                own = np.concatenate([nx, ny])
                i, j = _tree_links(len(own), pairs)
                a += own[i].tolist()
                b += own[j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return found.where("a is not null").select("a", "b").unionByName(full.mapInArrow(across, "a long, b long"))


def candidate_links(fps: DataFrame, masks: list[list[int]], differences: int) -> DataFrame:
    """``a, b`` for pairs of ``fps(node long, fp binary)`` to compare, and ``key, node, fp`` for the rows of runs whose pairs are not all among them.

    Pairs are those within ``differences`` that agree under a mask. Runs with many pairs, and those that reach a task's edge,
    are given row by row, for ``cell_links``.
    """
    bits = 8 * int(fps.select(F.octet_length("fp")).head()[0]) if not fps.isEmpty() else 64

    def index(batches: Iterator[pa.RecordBatch]):
        first = True
        for at, nodes, x, starts, stops, done in _whole_runs(batches, bits):
            runs = np.repeat(np.arange(len(starts)), stops - starts)
            edge = np.zeros(len(at), bool)
            if first:
                edge[:stops[0]] = True
            if done:
                edge[starts[-1]:] = True
            first = False
            i, j, dense = _listed_links(runs, _short_runs(x, starts, stops, differences))
            links, rows = [(i, j)], [dense]
            for k in np.flatnonzero(stops - starts > SHORT).tolist():
                s, e = int(starts[k]), int(stops[k])
                i, j, dense = _listed_links(np.zeros(e - s, np.int64), close_pairs(x[s:e], None, differences))
                links.append((s + i, s + j))
                rows.append(s + dense)
            i, j = (np.concatenate(v) for v in zip(*links, strict=True))
            rows = np.union1d(np.concatenate(rows), np.flatnonzero(edge))
            n, m = len(i), len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([nodes[i], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                pa.array(np.concatenate([nodes[j], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                pa.array(np.concatenate([np.zeros(n, np.int64), at[rows].astype(np.int64)]), mask=np.arange(n + m) < n),
                pa.array(np.concatenate([np.zeros(n, np.int64), nodes[rows]]), mask=np.arange(n + m) < n),
                pa.array([None] * n + [r.tobytes() for r in x[rows]], pa.binary())], ["a", "b", "key", "node", "fp"])

    return _ordered(fps, masks, bits).mapInArrow(index, "a long, b long, key long, node long, fp binary")


def cell_links(rows: DataFrame, sets: DataFrame, masks: list[list[int]], differences: int, similarity: float) -> DataFrame:
    """Links ``a, b`` of ``rows(key, node, fp, label)`` with ``sets(doc_id, shingles)``: pairs of a run within ``differences`` that reach ``similarity``.

    Every pair is compared, but those whose ends a chain of found links (``label`` is that of earlier ones) joins already, and
    those that agree under an earlier mask. Large runs are dealt over a grid of pairs of chunks; smaller ones share tasks.
    """
    sizes = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
                 .where("low <> high").select("key", "members"), "run_sizes")
    tasks = max(1, -(-(sizes.agg(F.sum("members")).head()[0] or 0) // CELL_ROWS))
    placed = rows.join(sizes, "key").join(sets, F.col("node") == F.col("doc_id")).withColumn("chunks", F.ceil(F.col("members") / F.lit(CELL)).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", "node", "fp", "label", "shingles", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.col("key")).alias("deal"), (F.col("chunks") == 1).alias("small"))
    shift = 8 * -(-len(masks[0]) // 8)
    wide = max(map(max, masks)) // 64 * 64 + 64

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        patterns = np.zeros((len(masks), wide), np.uint8)
        for m, mask in enumerate(masks):
            patterns[m, mask] = 1
        patterns = np.packbits(patterns, axis=1).view(np.uint64)
        links = []
        for key, g in pdf.groupby("key", sort=False):
            x, own, node = _words(g["fp"].tolist()), g["own"].to_numpy(), g["node"].to_numpy()
            sets, root = [np.asarray(s) for s in g["shingles"]], np.unique(g["label"].to_numpy(), return_inverse=True)[1].tolist()
            lengths = np.array([len(s) for s in sets])
            up = list(range(max(root) + 1))

            def top(k, up=up):
                while up[k] != k:
                    up[k] = k = up[up[k]]
                return k

            found = list(close_pairs(x, None, differences))
            if not found:
                continue
            i, j, d = (np.concatenate(v) for v in zip(*found, strict=True))
            ok = np.ones(len(i), bool) if g["i"].iloc[0] == g["j"].iloc[0] else own[i] != own[j]
            ok &= np.minimum(lengths[i], lengths[j]) >= similarity * np.maximum(lengths[i], lengths[j])
            i, j, d = i[ok], j[ok], d[ok]
            earlier, differ = np.zeros(len(i), bool), x[i] ^ x[j]
            for m in range(int(key) >> shift):
                width = patterns.shape[1]
                earlier |= ~(differ[:, :width] & patterns[m]).any(axis=1)
            i, j, d = i[~earlier], j[~earlier], d[~earlier]
            for p, q in zip(*(v[np.argsort(d, kind="stable")].tolist() for v in (i, j)), strict=True):
                a, b = top(root[p]), top(root[q])
                if a != b:
                    shared = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    if shared >= similarity * (len(sets[p]) + len(sets[q]) - shared):
                        up[a] = b
                        links.append((node[p], node[q]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cells.groupBy("small", "deal", "i", "j").applyInPandas(cell, "a long, b long")


def simhash_components(df: DataFrame, shingle: int = 5, bits: int = 256, differences: int = 38, masks: list[list[int]] | None = None,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (hex) ``, component_id``: the smallest id that a document reaches over near fingerprints.

    Ids are integers. Equal fingerprints are one class, linked like near ones; texts without words share the zero
    fingerprint. Rows with equal ids share a component through that id; a row whose id is null has a fingerprint and,
    as it can name no component, a null ``component_id``. An empty table gives no rows.
    Without ``masks`` they are the exact ones for ``differences``.
    """
    docs = keep(fingerprints(df, shingle, bits, id_col, text_col), "fingerprints")
    ids = F.col("doc_id").cast("long")
    classes = keep(docs.where("doc_id is not null").groupBy("fp").agg(F.min(ids).alias("node")), "classes")
    links = fingerprint_links(classes, masks or exact_masks(bits, differences), differences)
    again = docs.where("doc_id is not null").groupBy(ids.alias("id")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    by_id = again.select("id", F.explode("fps").alias("fp")).join(classes, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
    least = keep(components(links.unionByName(by_id)), "components")
    of_class = keep(classes.join(least, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "class_components")
    forget(classes, least)
    # Where one fingerprint has very many documents, Spark splits this join's left side.
    return docs.join(of_class, "fp", "left").select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingle_sets(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shingles array<int>``: distinct 32-bit hashes of each row's shingles."""
    source = texts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [np.unique(text_hashes(t.as_py(), shingle).astype(np.uint32)).view(np.int32) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "shingles"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, shingles array<int>")


def near_copies(df: DataFrame, similarity: float = 0.8, shingle: int = 5, bits: int = 256, slack: int = 20, masks: int = 96, width: int = 16,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of documents that are not their component's smallest id: the copies.

    Documents link if the sets of their word shingles have a Jaccard similarity of ``similarity`` or more. Fingerprints name
    the candidates: those that agree under a random mask of ``width`` bits and differ in at most ``slack`` bits more than such
    a similarity makes one expect. Every candidate pair is compared shingle by shingle, but where found links join its ends already. Texts of equal fingerprints are one class, texts without words too. Rows with equal ids are one document;
    one without an id is no copy. An empty table gives no rows.
    """
    docs = keep(fingerprints(df, shingle, bits, id_col, text_col), "fingerprints")
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "fp")
    classes = keep(named.groupBy("fp").agg(F.min("id").alias("node")), "classes")
    patterns, differences = random_masks(bits, width, masks), differences_at(similarity, bits) + slack
    near = keep(candidate_links(classes, patterns, differences), "near")
    pairs = keep(near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    dense = near.where("key is not null").select("key", "node", "fp")
    nodes = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(dense.select("node")).distinct(), "candidate_nodes")
    wanted = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    sets = keep(shingle_sets(wanted, shingle).groupBy("doc_id").agg(F.first("shingles").alias("shingles")), "shingle_sets")
    first, second = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    alike = shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared)
    links = keep(pairs.join(first, "a").join(second, "b").where(alike).select("a", "b"), "near_links")
    least = components(links)
    labelled = keep(dense.join(least, "node", "left").select("key", "node", "fp", F.coalesce("component", "node").alias("label")), "dense")
    more = cell_links(labelled, sets, patterns, differences, similarity)
    of_class = named.join(classes, "fp").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return components(links.unionByName(more).unionByName(of_class)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
