"""The pipeline, stage by stage, on documents with a known outcome."""

import random

import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from postlens.llm.store import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fingerprint(words):
    """Plain restatement: bits set in over half of the hashes of the three-word shingles."""
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copy(words):
    """The words with one changed, so that the fingerprint differs in 1 to 3 bits."""
    for i in range(3, len(words)):
        changed = [*words[:i], "changed", *words[i + 1:]]
        if 1 <= (fingerprint(words) ^ fingerprint(changed)).bit_count() <= 3:
            return changed
    raise AssertionError("no such place")


def planted():
    rng = random.Random(12)
    letters = {"en": "abcdefghij", "fr": "lmnopqrstu"}

    def sentence(lang, n=60):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 9))) for _ in range(n))

    def document(lang):
        return "\n".join(sentence(lang, 40) for _ in range(6))

    clean = [(lang, document(lang)) for lang in ("en", "fr") * 30]
    near = near_copy(clean[0][1].split())
    shared = sentence("en", 70)
    extra = {
        "no_letters": ("en", "12 -- 34"), "null": ("fr", None), "empty": ("en", ""),
        "near": ("en", " ".join(near)),  # one line, so no line of it repeats
        "line": ("fr", clean[1][1].split("\n")[2] + "\n" + document("fr")),
        "first": ("en", f"{document('en')} {shared} {sentence('en', 30)}"),
        "second": ("en", f"{document('en')} {shared} {sentence('en', 30)}"),
    }
    texts = [*clean, *extra.values()]
    names = {name: len(clean) + i for i, name in enumerate(extra)}
    return [(i, t, lang, f"src{i % 4}", None if t is None else len(t)) for i, (lang, t) in enumerate(texts)], names, shared


def test_stages(spark, tmp_path):
    rows, at, shared = planted()
    texts = {r[0]: r[1] for r in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, str(tmp_path)), f"test_{name}")
        if name != "packing":
            assert docs.columns == COLUMNS, name
            out[name] = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in docs.collect()), name
    assert list(out) == ["language_id", "line_dedup", "near_dedup", "passage_dedup"]
    kept = set(texts) - {at["no_letters"], at["null"], at["empty"]}
    assert out["language_id"] == {i: texts[i] for i in kept}
    # Of the repeated line the first stays.
    lines = {i: texts[i] for i in kept} | {at["line"]: texts[at["line"]].split("\n", 1)[1]}
    assert out["line_dedup"] == lines
    assert out["near_dedup"] == {i: t for i, t in lines.items() if i != at["near"]}
    passages = dict(out["near_dedup"])
    passages[at["second"]] = passages[at["second"]].replace(shared + " ", "")
    assert out["passage_dedup"] == passages
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(passages)
    total = {r.doc_id: r.doc_tokens for r in pieces}
    held = {}
    for r in pieces:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == total


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, "words of some length here", None, None, None), (3, "words of some length here", None, None, 1), (3, "other words than those", "xx", "s", 2)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = keep(stage(spark, docs, str(tmp_path)), f"odd_{name}")
        assert docs.count() >= (1 if rows else 0)


def test_run_reads_documents(spark, tmp_path):
    rows, _, _ = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 60


@pytest.mark.parametrize("stage, module, operator", [
    ("language_id", "langid", "fit_text_model"), ("near_dedup", "simhash", "simhash_components"),
    ("passage_dedup", "suffixes", "dedup_passages"), ("packing", "packing", "pack_documents")])
def test_workers_get_a_few_megabytes_at_once(spark, monkeypatch, stage, module, operator):
    """Of 24 MB of texts in one partition, which were one batch before."""
    class Seen(Exception):
        pass

    def batches(df, *args, **kwargs):
        def sizes(parts):
            for b in parts:
                yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

        raise Seen([r["size"] for r in df.select("text").mapInArrow(sizes, "size long").collect()])

    monkeypatch.setattr(getattr(corpus_pipeline, module), operator, batches)
    session = spark.newSession()
    docs = session.range(0, 240, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 9000) AS text", "'en' AS lang", "'a' AS source", "0L AS n_chars")
    with pytest.raises(Seen) as seen:
        dict(corpus_pipeline.STAGES)[stage](session, docs, "")
    sizes = seen.value.args[0]
    assert sum(sizes) > 23e6 and max(sizes) < 4.5e6, sizes
