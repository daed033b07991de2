"""SimHash, near vectors and components against brute force."""

import inspect

import numpy as np
import pytest
import xxhash

from postlens.llm import simhash, vectors
from postlens.llm.components import components
from postlens.llm.store import keep


def closure(n, linked):
    label = np.arange(n)
    while True:
        new = label.copy()
        for i in range(n):
            new[i] = label[linked[i]].min()
        if (new == label).all():
            return label
        label = new


def simple_simhash(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_components(spark):
    rng = np.random.default_rng(4)
    n = 400
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (260, 2))] + [(i, i + 1) for i in range(300, 399)] + [(7, int(x)) for x in rng.integers(0, 100, 60)]
    linked = np.eye(n, dtype=bool)
    for a, b in edges:
        linked[a, b] = linked[b, a] = True
    label = closure(n, [np.flatnonzero(r) for r in linked])
    frame = spark.createDataFrame([*edges, (None, 3), (4, 4)], "a long, b long")
    assert {r.node: r.component for r in components(frame).collect()} == {i: int(x) for i, x in enumerate(label) if x != i}
    assert components(frame.where("false")).count() == 0


@pytest.mark.parametrize("bits, differences", [(64, 3), (64, 20), (256, 38)])
def test_pairs_from_the_trees(bits, differences):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, (30, bits // 64), dtype=np.uint64)
    x = base[rng.integers(0, 30, 1500)]
    for row in x:
        for b in rng.integers(0, bits, rng.integers(0, 7)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    near = np.bitwise_count(x[:, None] ^ x[None]).sum(-1) <= differences
    i, j, d = (np.concatenate(v) for v in zip(*simhash.close_pairs(x, None, differences), strict=True))
    assert (np.bitwise_count(x[i] ^ x[j]).sum(-1) == d).all()
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(np.triu(near, 1)).tolist()]
    i, j, _ = (np.concatenate(v) for v in zip(*simhash.close_pairs(x[:400], x[400:], differences), strict=True))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(near[:400, 400:]).tolist()]


def test_gray_rank_orders_neighbours():
    codes = [i ^ (i >> 1) for i in range(256)]
    rows = np.unpackbits(np.array(codes, np.uint8)[:, None], axis=1)
    assert np.packbits(simhash.gray_rank(rows), axis=1).ravel().tolist() == list(range(256))


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_links_over_task_edges(spark, partitions):
    """One large group of close fingerprints spreads over many tasks; no link is lost."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2 ** 63, (60, 1), dtype=np.uint64)
    near = np.repeat(rng.integers(0, 2 ** 63, (3, 1), dtype=np.uint64), 200, axis=0)
    for row in near:
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            row[0] ^= np.uint64(1) << np.uint64(b)
    x = np.unique(np.concatenate([x, near]), axis=0)
    rng.shuffle(x)
    fps = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "node long, fp binary")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = keep(simhash.fingerprint_links(fps, simhash.exact_masks(64, 3), 3), "links")
        got = {r.node: r.component for r in components(links).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    label = closure(len(x), [np.flatnonzero(np.bitwise_count(x[:, 0] ^ r[0]) <= 3) for r in x])
    assert got == {i: int(v) for i, v in enumerate(label) if v != i}


def test_tasks_that_compare_members_have_one_python_worker(spark):
    """Blocks that meet over task edges are written before their members are compared: two functions in a task take two workers."""
    fps = spark.createDataFrame([(i, bytearray(np.uint64(1 << i).tobytes())) for i in range(40)], "node long, fp binary")
    links = simhash.fingerprint_links(fps, simhash.exact_masks(64, 3), 3)
    assert links._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_simhash_of_texts(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    texts = [None, "", " \n", "one", "One", "two words", "A bÉ c", "a bÉ C", "x " * 20000]
    for _ in range(40):
        copy = list(base)
        copy[int(rng.integers(0, 120))] = "changed"
        texts.append(" ".join(copy))
    texts += [" ".join(f"u{i}" for i in rng.integers(0, 10 ** 6, 50)) for _ in range(30)]
    schema = "doc_id long, text string, fp int, node int, a int, component_id int, `mask` int, fingerprint int"
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)], schema)
    got = {r.doc_id: r for r in simhash.simhash_components(docs, 3, 64, 3).collect()}
    prints = np.array([simple_simhash(t, 3) for t in texts], np.uint64)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{int(p):016x}" for p in prints]
    label = closure(len(texts), [np.flatnonzero(np.bitwise_count(prints ^ p) <= 3) for p in prints])
    assert [got[i].component_id for i in range(len(texts))] == label.tolist()


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "q w e r t y"), (2, "a b c"), (None, "a b c"), (9, "q w e r t y")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_components(docs, 3, 64, 3).collect())
    assert got == [(-1, None), (2, 2), (5, 2), (5, 2), (9, 2)]
    assert simhash.simhash_components(docs.where("false"), 3, 64, 3).count() == 0


def test_near_copies(spark):
    """Near copies of similarity 0.8 and more, against brute force over all pairs of shingle sets."""
    rng = np.random.default_rng(9)
    texts = [None, "", " ", "few words", "few words", "few other"]
    for g in range(60):
        words = [f"w{i}" for i in rng.integers(0, 5000, int(rng.integers(80, 400)))]
        texts.append(" ".join(words))
        for changes in (2, 5, 12):
            copy = list(words)
            for at in rng.integers(0, len(words), changes):
                copy[at] = f"x{rng.integers(0, 10 ** 6)}"
            texts.append(" ".join(copy))
    hot = [f"h{i}" for i in rng.integers(0, 5000, 200)]
    for _ in range(250):
        copy = list(hot)
        copy[int(rng.integers(0, 200))] = f"x{rng.integers(0, 10 ** 6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, node int, shingles int").repartition(5)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    linked = [[] for _ in texts]
    close = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                linked[i].append(j)
                close += i < j
    label = closure(len(texts), [np.array(x) for x in linked])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    want = {i: int(x) for i, x in enumerate(label) if x != i}
    wrong = {i for i in got if got[i] != want.get(i)}
    missed = set(want) - set(got)
    assert not wrong and len(missed) <= 0.02 * len(want), (len(missed), len(want))
    assert simhash.near_copies(docs.where("false")).count() == 0


def test_candidates_at_the_similarity():
    """Of pairs at 0.8, about 0.99 are candidates of near_copies."""
    own = {n: p.default for n, p in inspect.signature(simhash.near_copies).parameters.items()}
    rng = np.random.default_rng(14)
    hashes = rng.integers(0, 2 ** 64, (1500, 333), dtype=np.uint64)
    a, b = (np.unpackbits(np.array([np.frombuffer(simhash.majority(h, 4), np.uint8) for h in some]), axis=1) for some in (hashes[:, :300], hashes[:, 33:]))
    differ = a != b
    agree = np.any([~differ[:, m].any(axis=1) for m in simhash.random_masks(256, own["width"], own["masks"])], axis=0)
    within = differ.sum(axis=1) <= simhash.differences_at(own["similarity"], 256) + own["slack"]
    assert (agree & within).mean() >= 0.98


def test_near_copies_among_documents_of_one_template(spark):
    """Pairs of 0.82 in a group whose others are 0.7 to 0.79 alike, where the nearest fingerprint is often another document's."""
    rng = np.random.default_rng(13)
    template = [f"t{i}" for i in range(300)]
    places = np.arange(3, 297, 6)

    def changed(at):
        words = list(template)
        for k in at:
            words[k] = f"x{rng.integers(0, 10 ** 9)}"
        return words

    docs = [changed(rng.choice(places, 4, replace=False)) for _ in range(260)]
    for _ in range(30):
        at = rng.choice(places, 8, replace=False)
        both = changed(at[:2])
        for own in (at[2:5], at[5:]):
            docs.append([b if k in at[:2] or k not in own else f"x{rng.integers(0, 10 ** 9)}" for k, b in enumerate(both)])
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in docs]
    linked = [np.array([j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)]) for a in sets]
    label = closure(len(docs), linked)
    want = {i: int(x) for i, x in enumerate(label) if x != i}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    assert len(want) >= 30
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.05 * len(want), (len(got), len(want))


def test_near_vectors(spark):
    rng = np.random.default_rng(10)
    rows = []
    for label in (1, 2):
        for _ in range(60):
            rows.append((label, rng.standard_normal(16)))
        centre = rng.standard_normal(16)
        rows += [(label, centre + 0.06 * rng.standard_normal(16)) for _ in range(1300)]  # more than a window and a chunk
        rows += [(label, rows[-1][1])] * 40
    order = rng.permutation(len(rows))
    data = [(i, rows[k][1].astype(np.float32).tolist(), rows[k][0]) for i, k in enumerate(order)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    n = len(data)
    data += [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 6, data[0][1], None), (n + 7, data[0][1][:8], data[0][2]), (n + 8, [1e-30] + [0.0] * 15, 9), (n + 9, [1e-30] + [0.0] * 15, 9)]
    docs = spark.createDataFrame([(*d, "x", 1, 2) for d in data], "vec_id long, embedding array<float>, label int, class string, node int, component int").repartition(6)
    got = {r.vec_id: r for r in vectors.near_vectors(docs).collect()}
    x = np.array([d[1] for d in data[:n]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([d[2] for d in data[:n]])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    head = closure(n, [np.flatnonzero(r) for r in linked])
    assert [got[i].n_links for i in range(n)] == (linked.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(n)] == head.tolist() and all(got[i].kept == (head[i] == i) for i in range(n))
    assert all((got[n + i].n_links, got[n + i].component_id, got[n + i].kept) == (0, n + i, True) for i in range(8))
    assert (got[n + 8].n_links, got[n + 9].component_id) == (1, n + 8)
    assert vectors.near_vectors(docs.where("false")).count() == 0


def test_pairs_of_a_dense_label_are_found(spark):
    """3,000 vectors with a mean cosine of 0.9, 100 of which have one partner at 0.981; windows of 16, so passes have to find them."""
    rng = np.random.default_rng(8)

    def across(*others):
        r = rng.standard_normal(32)
        for o in np.linalg.qr(np.array(others).T)[0].T:
            r -= (r @ o) * o
        return r / np.linalg.norm(r)

    middle = across(rng.standard_normal(32))
    x = [0.9 ** 0.5 * middle + 0.1 ** 0.5 * across(middle) for _ in range(3000)]
    x += [0.981 * v + (1 - 0.981 ** 2) ** 0.5 * across(middle, v) for v in x[:100]]
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>").repartition(3)
    x = np.array(x)
    linked = x @ x.T >= 0.98
    np.fill_diagonal(linked, False)
    assert linked[np.arange(100), np.arange(100) + 3000].all()
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, window=16).collect()}
    assert [got[i] for i in range(3100)] == linked.sum(axis=1).tolist()


def test_passes_grow_with_a_label():
    def needed(n, likeness):
        return vectors.passes_needed(n, likeness, 0.98, 512, 1e-4)

    assert needed(100, 0.0) == vectors.FEWEST_PASSES and needed(10 ** 6, 0.0) > needed(10 ** 4, 0.0)
    assert needed(10 ** 5, 0.9) > 4 * needed(10 ** 5, 0.0) and needed(10 ** 5, 1.0) >= needed(10 ** 5, 0.9)
