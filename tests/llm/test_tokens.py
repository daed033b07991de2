"""BPE, token files and packing against the tokenizers library."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from postlens.llm import bpe, memo, packing, tokenfile  # noqa: E402
from postlens.session import work_path  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", " ", "\n", "'s", "<|endoftext|>", "<|startoftext|>", "É", "é", "Σ", "word,", "99", "\t", " ", "　", "\x85", "\x1c",
         "İ", "\U0001f389", "中文", ".", "a", "a", "\r\n", "½", "\0"]
TEXTS = ["", " ", "\n\n", "a  b   c", "it's 'llama' don't", "x" * 5000, "aaaa" * 700, "<|endoftext|>", "word " * 3000]
rng = random.Random(3)
TEXTS += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(400)]
CLASHING = "ids string, start int, length int, part int, n_tokens int, words int, `rank` int, `index` int"


def frame(spark, texts):
    rows = [(i, t, "x", 1, 2, 3, 4, 5, 6, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")


def expected(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], t


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_remembered_pieces_are_exact(path):
    want, _ = expected(path, TEXTS)
    enc = memo.PieceEncoder(path)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(TEXTS)] == want


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_slice_looks_up_its_distinct_pieces_once(path):
    enc = memo.PieceEncoder(path)
    asked = []
    enc._remember = lambda pieces, f=enc._remember: asked.extend(pieces) or f(pieces)
    texts = ["one more word, one more line", "", "one more\nword", "and it's (one)."] * 50 + ["wide  gap, one", "\u3000é.b 3.5,a"]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    whole = pa.array(["left out", *texts])
    for given in (texts, whole.slice(1), whole.cast(pa.large_string()).slice(1)):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(given)] == want
    assert len(set(asked)) <= 25 and len(asked) < 50, asked
    assert enc.encode([]) == [] and enc.encode(["", ""]) == [b"", b""]


def test_remembered_pieces_move_to_a_new_generation(monkeypatch):
    monkeypatch.setattr(memo, "REMEMBERED", 5)
    enc, (want, _) = memo.PieceEncoder(BYTES), expected(BYTES, TEXTS)
    for t, ids in zip(TEXTS, want, strict=True):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == ids


def test_pair_index_merges_as_the_library_does():
    want, t = expected(BYTES, TEXTS)
    own = bpe.PairIndexBpe(BYTES)
    for ids, (raw, decimals) in zip(want, own.encode(TEXTS), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids and decimals[:-1] == ",".join(map(str, ids))
        assert own.decode(np.array(ids, np.int64)) == t.decode(ids, skip_special_tokens=False)


def test_bpe_digest_and_round_trip(spark):
    texts = [*TEXTS, None, None, TEXTS[3]]
    want, t = expected(BYTES, texts)
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in bpe.bpe_digest(docs, BYTES).collect()}
    for i, ids in enumerate(want):
        text = t.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(docs, BYTES), BYTES).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.bpe_digest(docs.where("false"), BYTES).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.n_tokens for r in bpe.bpe_digest(twice, BYTES).collect()] == [2, 2]


@pytest.mark.parametrize("widths", [(1,), (16,), (1, 3, 16, 32), (31, 32)])
def test_words_round_trip(widths):
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(0, 2 ** w, 500) for w in widths]).astype("<u4")
    r.shuffle(ids)
    ends = np.unique(np.append(r.integers(1, len(ids), 40), len(ids)))
    words, heads = tokenfile.pack_ids(ids, ends)
    assert (tokenfile.unpack_ids(words) == ids).all()
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        upto = heads[k + 1] if k + 1 < len(heads) else len(words)
        assert (tokenfile.unpack_ids(words[heads[k]:upto]) == ids[a:b]).all()
    assert len(tokenfile.pack_ids(ids[:0], ends[:0])[0]) == 0


def test_token_file(spark):
    texts = [*TEXTS, None]
    want, _ = expected(BYTES, texts)
    path = work_path(spark, "tokens")
    tokenfile.write_token_file(frame(spark, texts).repartition(5), path, BYTES, end_id=2)
    start = 0
    got = {r.doc_id: r for r in tokenfile.check_token_file(spark, path).collect()}
    full = {r.doc_id: r for r in tokenfile.read_token_file(spark, path).collect()}
    for i, ids in enumerate(want):
        ids = [*ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (full[i].start, full[i].ids) == (start, ids)
        start += len(ids)


def test_token_file_edges(spark):
    path = work_path(spark, "tokens")
    tokenfile.write_token_file(frame(spark, []), path, BYTES, end_id=2)
    assert tokenfile.check_token_file(spark, path).count() == 0
    path = work_path(spark, "tokens")
    rows = [(None, "b"), (3, "b"), (3, "a"), (3, "a"), (1, None)]
    tokenfile.write_token_file(spark.createDataFrame(rows, "doc_id long, text string"), path, BYTES, end_id=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.check_token_file(spark, path).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 3, 2), (5, 3, 2), (7, 3, 2)]


def test_histogram_is_used_up():
    r = np.random.default_rng(2)
    for n in (1, 50, 5000):
        histogram = dict(Counter(r.integers(1, 65, n).tolist()))
        patterns = packing.pack_histogram(histogram, 64)
        used = Counter()
        for pattern, count in patterns:
            assert sum(pattern) <= 64 and count > 0
            used += Counter({x: k * count for x, k in Counter(pattern).items()})
        assert used == histogram
    assert packing.pack_histogram({}, 64) == []
    spare = 64 * sum(c for _, c in patterns) - sum(k * c for k, c in histogram.items())
    assert spare < 0.02 * 64 * sum(c for _, c in patterns)


@pytest.mark.parametrize("histogram, sequences", [({1000: 9000}, 4500), ({100: 90000}, 4500), ({700: 5}, 3), ({2048: 7, 1: 2049}, 9)])
def test_equal_lengths_share_sequences(histogram, sequences):
    patterns = packing.pack_histogram(histogram, 2048)
    assert sum(n for _, n in patterns) == sequences
    assert all(sum(p) <= 2048 for p, _ in patterns)
    assert {k: sum(p.count(k) * n for p, n in patterns) for k in histogram} == histogram


def test_a_hot_length_leaves_little_room():
    rng = random.Random(15)
    histogram = {}
    for _ in range(6000):
        n = rng.randint(1, 2048)
        histogram[n] = histogram.get(n, 0) + 1
    histogram[700] = histogram.get(700, 0) + 3000
    patterns = packing.pack_histogram(histogram, 2048)
    assert {k: sum(p.count(k) * n for p, n in patterns) for k in histogram} == histogram
    alone = sum(n for k, n in histogram.items() if k > 1348)  # with no other piece of 700 or more
    two = sum(n for k, n in histogram.items() if 700 <= k <= 1348)  # at most two of them in a sequence
    assert sum(n for _, n in patterns) <= alone + -(-two // 2) + 10


def test_packing(spark):
    texts = [*TEXTS, None, *["one two three"] * 300]
    want, _ = expected(WORDS, texts)
    rows = packing.pack_documents(frame(spark, texts).repartition(7), WORDS, end_id=1, size=64).collect()
    pieces, sequences = {}, {}
    for r in rows:
        ids = [*want[r.doc_id], 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i in range(len(texts)):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(want[i]) + 1
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_edges(spark):
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(None, "a"), (None, "a"), (5, None)], "doc_id long, text string"), WORDS, size=8).collect()
    assert sorted((r.length, r.doc_id is None) for r in rows) == [(1, False), (2, True), (2, True)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_vocabulary_stays_outside_the_repository():
    with open(BYTES, encoding="utf-8") as f:
        assert json.load(f)["model"]["type"] == "BPE"
    assert "repo" not in BYTES
