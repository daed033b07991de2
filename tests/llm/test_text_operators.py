"""Lines, passages, languages, licences and fingerprints against brute force and on odd rows."""

import random
import re
import time
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest

from postlens.llm import fingerprints, langid, licenses, lines, suffixes

CLASHING = "`row` int, id int, `of` int, `at` int, n int, keys int, stay int, spans int, fit int, term int, n_chars int"
FILL = tuple(range(11))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *FILL) for i, t in enumerate(texts)], f"doc_id long, text string, {CLASHING}")


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def test_lines(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(14, 40))).strip() for _ in range(60)]
    texts = [None, "", "\n\n", "short\nshort\nshorr", base[0] * 400]
    for _ in range(120):
        some = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(base)
            p = rng.randrange(len(x))
            some.append(rng.choice([x, x, f" {x} ", x[:p] + x[p + 1:], x[:p] + "q" + x[p + 1:], x[:p] + "z" + x[p:], ""]))
        texts.append("\n".join(some))
    place, first = {}, {}
    for i, t in enumerate(texts):
        for j, x in enumerate((t or "").split("\n")):
            place[i, j] = x.strip(" ")
            first.setdefault(x.strip(" "), (i, j))
    long = [x for x in first if len(x) >= 16]
    gone = {max(first[a], first[b]) for a, b in combinations(long, 2) if within_one(a, b)}
    want = {}
    for i, t in enumerate(texts):
        kept = [x for j, x in enumerate((t or "").split("\n")) if not place[i, j] or (first[place[i, j]] == (i, j) and (i, j) not in gone)]
        want[i] = None if t is None else "\n".join(kept)
    out = lines.dedup_lines(frame(spark, texts))
    got = out.collect()
    assert gone and {r.row.doc_id: r.row.text for r in got} == want
    assert {tuple(r.row)[2:] for r in got} == {FILL}
    assert {r.row.doc_id: r.n_lines for r in got} == {i: 0 if t is None else len(t.split("\n")) for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("wide", [128, 1])
def test_lines_near_from_any_length(spark, monkeypatch, wide):
    rng = random.Random(5)
    monkeypatch.setattr(lines, "WIDE", wide)
    texts = ["\n".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 17, 64, 65, 150]))) for _ in range(4)) for _ in range(60)]
    longer = [t.split("\n")[0] for t in texts if len(t.split("\n")[0]) > 60]
    texts += [x[:p] + c + x[q:] for x in longer for p in (0, 30, len(x) - 1) for c, q in (("z", p), ("z", p + 1), ("", p + 1))]
    first = {}
    for i, t in enumerate(texts):
        for j, x in enumerate(t.split("\n")):
            first.setdefault(x, (i, j))
    gone = {max(first[a], first[b]) for a, b in combinations([x for x in first if x], 2) if within_one(a, b)}
    want = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if not x or (first[x] == (i, j) and (i, j) not in gone)) for i, t in enumerate(texts)}
    got = {r.row.doc_id: r.row.text for r in lines.dedup_lines(frame(spark, texts), near_from=0).collect()}
    assert len(gone) > 60 and got == want


def test_long_documents_and_lines(spark):
    many = "\n".join(f"line number {i} of this long document" for i in range(20_000))
    rng = random.Random(6)
    wide = "".join(rng.choice("abcdef ") for _ in range(1_000_000)).strip()
    texts = [many, wide, wide[:500_000] + "!" + wide[500_000:], wide[:300] + "?" + wide[301:], "", many.split("\n")[77] + "\nnew line of the last document"]
    got = {r.row.doc_id: (r.row.text, r.n_kept) for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got[1][0] == wide and got[2] == ("", 0) and got[3] == ("", 0) and got[5] == ("new line of the last document", 1)
    kept, first = [], {}
    for i in range(20_000):  # lines of one length that differ in one digit are near an earlier one
        x = str(i)
        if not any((len(x), p, x[:p] + x[p + 1:]) in first for p in range(len(x))) and not any(x[:p] + x[p + 1:] in first for p in range(len(x))):
            kept.append(i)
        first.setdefault(x, i)
        for p in range(len(x)):
            first.setdefault((len(x), p, x[:p] + x[p + 1:]), i)
    assert got[0][0].split("\n") == [f"line number {i} of this long document" for i in kept]


def test_lines_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "the same line here"), (None, "the same line here"), (1, "the same line here"), (1, "another line, longer"), (1, "the same line here")],
                                 "doc_id long, text string")
    got = sorted((r.row.doc_id or -1, r.row.text, r.n_kept) for r in lines.dedup_lines(docs).collect())
    assert got == [(-1, "the same line here", 1), (-1, "the same line here", 1), (1, "", 0), (1, "", 0), (1, "another line, longer", 1)]
    assert lines.dedup_lines(docs.where("false")).count() == 0


def words(rng, n):
    return [f"w{rng.randrange(10 ** 7)}" for _ in range(n)]


def passages(texts, size=50):
    holders = defaultdict(set)
    split = [(t or "").split() for t in texts]
    for i, w in enumerate(split):
        for j in range(len(w) - size + 1):
            holders[tuple(w[j:j + size])].add(i)
    covered, extra = defaultdict(set), defaultdict(set)
    for i, w in enumerate(split):
        for j in range(len(w) - size + 1):
            who = holders[tuple(w[j:j + size])]
            if len(who) > 1:
                covered[i].update(range(j, j + size))
                if min(who) < i:
                    extra[i].update(range(j, j + size))
    return covered, extra


def places(spans):
    return {p for s in spans for p in range(s["start"], s["stop"])}


def test_repeated_passages(spark):
    rng = random.Random(2)
    texts = [None, "", "word " * 4000]
    for n in (49, 50, 51, 60, 83, 400):
        shared = words(rng, n)
        for _ in range(3):
            texts.append(" ".join(words(rng, rng.randrange(80)) + shared + words(rng, rng.randrange(80))))
    twice = words(rng, 70)
    texts.append(" ".join(twice + ["between"] + twice))  # in one document only
    texts += [" ".join(words(rng, 120)) for _ in range(20)]
    texts += [texts[-1]] * 4
    hot = words(rng, 64)
    texts += [" ".join(words(rng, 30) + hot + words(rng, 30)) for _ in range(150)]
    covered, extra = passages(texts)
    docs = frame(spark, texts).repartition(5)
    got = {r.doc_id: r for r in suffixes.repeated_passages(docs).collect()}
    assert set(got) == set(covered)
    for i, r in got.items():
        assert places(r.spans) == covered[i] and r.n_words == len(covered[i]) and r.n_spans == len(r.spans) and i not in r.other_ids and r.other_ids
        assert places(r.extra_spans) == extra[i]
    out = {r.row.doc_id: r.row for r in suffixes.dedup_passages(docs).collect()}
    for i, t in enumerate(texts):
        if t is None or not extra[i]:
            assert out[i].text == t
        else:
            assert out[i].text.split() == [w for j, w in enumerate(t.split()) if j not in extra[i]]
    assert {tuple(r)[2:] for r in out.values()} == {FILL}


@pytest.mark.parametrize("partitions", ["2", "50"])
def test_passages_over_task_edges(spark, partitions):
    rng = random.Random(3)
    shared = words(rng, 55)
    texts = [" ".join(words(rng, 5) + shared + words(rng, 5)) for _ in range(40)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.n_words for r in suffixes.repeated_passages(frame(spark, texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict.fromkeys(range(40), 55)


@pytest.mark.parametrize("rows", ["1", "3", "64"])
def test_passages_built_of_few_blocks(spark, rows):
    """Texts joined from shared blocks, so passages meet, nest and share edges; few suffixes in a batch, and several tasks."""
    rng = random.Random(23)
    blocks = [words(rng, rng.choice([6, 17, 33, 36, 45, 52])) for _ in range(14)]
    texts = [" ".join(w for _ in range(rng.randrange(1, 9)) for w in rng.choice(blocks)) for _ in range(60)]
    texts += [" ".join(w for _ in range(6) for w in blocks[0] + blocks[3])] + texts[:5]
    covered, extra = passages(texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in suffixes.repeated_passages(frame(spark, texts).repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(covered)
    for i, r in got.items():
        assert places(r.spans) == covered[i] and places(r.extra_spans) == extra[i]


def test_neighbours_settle_what_agrees():
    """Of three suffixes that agree on all words around, the later two are settled; where words differ, heads stay open."""
    rows = [(1, 9, b"aa", b"b", 0, 3, 1, 1, 5), (2, 9, b"aa", b"b", 0, 3, 1, 1, 7), (2, 9, b"aa", b"b", 0, 3, 4, 2, 7), (2, 9, b"aa", b"b", 0, 3, 5, 3, 7),
            (3, 9, b"aa", b"b", 0, 3, 1, 1, 9), (3, 9, b"aa", b"c", 0, 3, 6, 4, 9), (4, 9, b"aa", b"b", 0, 3, 1, 1, 11)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], suffixes.SUFFIX)
    head, own, paired, wide = suffixes.neighbours(batch)
    assert head.tolist() == [0, 1, 1, 1, 4, 5, 6] and own.tolist() == [True, True, False, False, True, True, True]
    assert paired.tolist() == [1] and wide.tolist() == [0, 4, 5, 6]


def test_passages_of_odd_rows(spark):
    rng = random.Random(4)
    text = " ".join(words(rng, 90))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (7, "else"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words) for r in suffixes.repeated_passages(docs).collect()}
    assert got == {(None, 90), (7, 90)}
    assert sorted((r.row.doc_id or -1, r.row.text) for r in suffixes.dedup_passages(docs).collect() if r.row.text is not None) == [(-1, text), (7, ""), (7, ""), (7, "else")]
    assert suffixes.repeated_passages(docs.where("false")).count() == 0


def test_passages_with_a_common_end(spark):
    """40 common words, which 60 documents have; in pairs also the 10 words before them. And a passage twice in the first document."""
    rng = random.Random(16)

    def some(n):
        return [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]

    common, twice = some(40), some(55)
    docs = []
    for _ in range(30):
        front = some(10)
        docs += [some(30) + front + common + some(30) for _ in range(2)]
    docs += [some(9) + twice + some(9) + twice, some(9) + twice + some(9)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.repeated_passages(frame).collect()}

    def spans(rows):
        return [(x.start, x.stop) for x in rows]

    for i in range(60):
        assert spans(got[i].spans) == [(30, 80)] and got[i].other_ids == [i ^ 1]
        assert spans(got[i].extra_spans) == ([(30, 80)] if i % 2 else [])
    assert spans(got[60].spans) == [(9, 64), (73, 128)] and not got[60].extra_spans
    assert spans(got[61].spans) == spans(got[61].extra_spans) == [(9, 64)] and got[61].other_ids == [60]


def exchanged(node):
    """Rows written to the shuffles of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    below = node.children()
    return own + sum(exchanged(below.apply(i)) for i in range(below.size()))


def test_texts_without_passages_are_not_shuffled(spark):
    """Of 400 documents two share a passage; the others are put out where they are read."""
    rng = random.Random(31)
    shared = words(rng, 60)
    texts = [" ".join(words(rng, 80)) for _ in range(397)] + [None] + [" ".join(words(rng, 10) + shared) for _ in range(2)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffixes.dedup_passages(frame(spark, texts).repartition(4).localCheckpoint())
        got = {r.row.doc_id: r.row for r in out.collect()}
        assert exchanged(out._jdf.queryExecution().executedPlan()) < 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [got[i].text for i in range(399)] == texts[:399] and got[399].text.split() == texts[399].split()[:10]
    assert {tuple(r)[2:] for r in got.values()} == {FILL}


def test_flags_lose_nothing(spark):
    """Hashes that are held are flagged, negative ones and those that share a slot or a row of bits too; few others are."""
    rng = random.Random(32)
    held = [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(500)]
    held += [-1, 0, 63, 64, 2 ** 63 - 1, -2 ** 63, held[0], held[0] ^ 1 << 40]
    other = [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(2000)]
    rows = spark.createDataFrame([(h, i) for i, h in enumerate(held + other)], "key long, i int")
    flagged = suffixes._flagged(rows, "key", spark.createDataFrame([(h,) for h in held], "key long"))
    assert flagged.columns == ["key", "i", "maybe"]
    got = [r.maybe for r in flagged.orderBy("i").collect()]
    assert len(got) == len(rows.collect()) and all(got[:len(held)]) and sum(got[len(held):]) < 10
    assert suffixes._flagged(rows, "key", rows.select("key").where("false")).where("maybe").count() == 0


def test_cut_passages():
    text = "a  b\nc d\n e"
    assert suffixes.cut_passages(text, [{"start": 1, "stop": 3}]) == "a  d\n e"
    assert suffixes.cut_passages(text, [{"start": 0, "stop": 5}]) == ""


def sentences(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language_evidence(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcdefg", "bb": "ghijklm", "cc": "nopqrsé"}
    rows = [(i, sentences(rng, alphabets[x], rng.randint(5, 60)), x, f"host{i % 3}", f"s{i % 3}") for i, x in enumerate(list(alphabets) * 80)]
    docs = spark.createDataFrame([(*r, *FILL) for r in rows], f"doc_id long, text string, lang string, host string, suffix string, {CLASHING}")
    model = langid.fit_text_model(docs.where("doc_id < 150"))
    assert model.languages == ["aa", "bb", "cc"]
    held = docs.where("doc_id >= 150")
    got = {r["row"].doc_id: r for r in langid.identify(held, model, declared_col="lang", host_col="host", suffix_col="suffix").collect()}
    assert len(got) == 90 and all(r.accepted and r.language == r["row"].lang and 0.5 <= r.confidence <= 1 for r in got.values())
    assert {tuple(r["row"])[5:] for r in got.values()} == {FILL}
    alone = langid.identify(held, model, id_col="doc_id").collect()
    assert sum(r.language == rows[r.row][2] for r in alone) == 90
    # A text that tells nothing follows its host and declaration.
    odd = [(1000, "g g g g", "bb", "host1", "s1"), (1001, "g g g g", None, "host0", "s0"), (1002, None, "aa", "host0", "s0"), (1003, "", "aa", None, None),
           (1004, "12 34 !!", "aa", "host2", "s2"), (None, rows[0][1], None, None, None), (None, rows[0][1], "not a code", None, None), (1005, "é" * 50000, "cc", "new", "s9")]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, host string, suffix string")
    judged = langid.identify(docs.select(*more.columns).unionByName(more), model, declared_col="lang", host_col="host", suffix_col="suffix", id_col="doc_id")
    got = {r.row: r for r in judged.where("row >= 1000 or row is null").collect()}
    assert (got[1000].language, got[1001].language) == ("bb", "aa")
    assert all((got[i].accepted, got[i].language, got[i].confidence) == (False, "und", 0.0) for i in (1002, 1003, 1004))
    assert got[None].language == "aa" and got[1005].accepted
    assert langid.identify(more.where("false"), model, declared_col="lang").count() == 0
    assert langid.fit_text_model(docs.where("false")).languages == ["und"]


def test_page_evidence(spark):
    html = "<HTML  class=x lang='fr-CA'><script>var a = '<p>';</script><p>Bonjour<!-- no --> tout</p></html>"
    pages = spark.createDataFrame([(1, "https://Www.Site.Example.org:80/fr?x", html), (2, None, None)], "page_id long, url string, html string")
    a, b = langid.page_evidence(pages).orderBy("page_id").collect()
    assert a.text.split() == ["Bonjour", "tout"] and (a.declared, a.host, a.suffix) == ("fr-CA", "www.site.example.org", "org")
    assert b.text == ""


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["MIT"]), ("MIT or Apache-2.0 AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]),
    ("(MIT OR GPL-2.0+) AND ISC", ["MIT", "GPL-2.0+", "or", "ISC", "and"]),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "or"]),
    ("", None), ("AND MIT", None), ("(MIT", None), ("MIT)", None), ("MIT Apache", None), ("MIT OR", None)])
def test_license_expressions(text, postfix):
    assert licenses.parse_expression(text) == postfix


@pytest.mark.parametrize("text, labels, expressions", [
    ("<!-- SPDX-License-Identifier: MIT -->", "mit", ["MIT"]), ("SPDX-License-Identifier: MIT and then more words", "mit", ["MIT and then"]),
    ("/* spdx-license-identifier: (MIT OR Apache-2.0) */ SPDX-License-Identifier:BSD-3-Clause", "apache,bsd,mit", ["( MIT OR Apache-2.0 )", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: (MIT or", "", []), ("SPDX-License-Identifier: MIT)\nor GPL-2.0", "mit", ["MIT"]),
    ("SPDX-License-Identifier: GPL-2.0 with Classpath-exception-2.0, all files", "gpl", ["GPL-2.0 with Classpath-exception-2.0"]),
])
def test_license_tags_within_lines(spark, text, labels, expressions):
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.expressions) == (labels, expressions)


def test_licenses_against_brute_force(spark):
    rng = random.Random(7)
    bits = ["MIT", "mit", "License", "license", "Apache", "general", "GENERAL", "public", "é", "word", "9", ",", "-", "\n", "the"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "  ", "-", "", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, ""]
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = {}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        found = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
        at = sorted((j, label) for p, label in phrases.items() for j in range(len(found)) if found[j:j + len(p.split())] == p.split())
        want[i] = (len(found), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100


def test_license_scan_is_linear():
    scan = licenses.Scanner().scan

    def cost(n):
        started = time.perf_counter()
        scan("mit license " * n)
        scan("SPDX-License-Identifier: MIT " * n)
        return time.perf_counter() - started

    cost(100)
    assert cost(80_000) < 12 * max(cost(20_000), 0.02)


def test_license_evaluation():
    def asks(x):
        return licenses.evaluate(licenses.parse_expression(x))

    assert asks("GPL-3.0 OR MIT") == ({"gpl", "mit"}, 1) and asks("GPL-3.0 AND MIT") == ({"gpl", "mit"}, 3)
    assert asks("GPL-2.0 WITH X") == ({"gpl"}, 2) and asks("Unheard-1.0") == (set(), None)


def test_license_scan(spark):
    texts = [None, "", "MIT  License, and the mit-license MIT License", "see GNU General Public\nLicense; 'Apache License' too", "permit license", "ÉMIT LICENSE mit licenseé",
             "x\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\ny", "İ SPDX-License-Identifier: GPL-2.0-only WITH\nmit license", "word " * 50000 + "mit license"]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts)).collect()}

    def short(i):
        r = got[i]
        return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels

    assert short(0) == short(1) == (0, 0, None, None, "", "") and got[0].score == 0
    assert short(2) == (8, 3, 0, 6, "mit", "mit")
    assert short(3) == (8, 2, 2, 5, "apache,gpl", "apache,gpl")
    assert short(4)[1:] == short(5)[1:] == (0, None, None, "", "")
    assert got[6].labels == "apache,bsd,mit" and got[6].base_labels == "" and got[6].asks == 1 and got[6].expressions == ["(MIT OR Apache-2.0) AND BSD-3-Clause".replace("(", "( ").replace(")", " )")]
    assert got[7].expressions == [] and got[7].labels == "mit"
    assert short(8) == (50002, 1, 50000, 50000, "mit", "mit") and all(0 <= r.score <= 1 for r in got.values())
    assert licenses.license_scan(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(400)]
    texts = [" ".join(rng.sample(vocabulary, 80)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), None, "", "", "é!" * 9, "lonely words only", "other single things", " ".join(vocabulary) * 30]
    docs = frame(spark, texts).repartition(6)
    out = fingerprints.fingerprints(docs)
    got = {r.doc_id: r for r in out.collect()}
    import hashlib
    flat = [t or "" for t in texts]
    for i, t in enumerate(flat):
        k, after = len(t) // 4, flat[(i + 1) % len(flat)]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[:len(t) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[60].fingerprint == got[61].fingerprint and got[60].near_next == 1
    assert got[62].fingerprint == got[63].fingerprint == got[64].fingerprint
    assert len({got[i].fingerprint for i in range(60)} | {got[66].fingerprint, got[67].fingerprint}) == 62
    near = sum(got[i].near_edited for i in range(59)) / 59
    assert near > 0.2 and near > 3 * sum(got[i].near_next for i in range(59)) / 59
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, "c d e f"), (4, "c d e f"), (4, "g"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_chars) for r in fingerprints.fingerprints(docs).collect())
    assert got == [(-1, 3), (2, 0), (4, 1), (4, 7)]
    assert fingerprints.fingerprints(docs.where("false")).count() == 0
    (one,) = fingerprints.fingerprints(docs.where("text = 'g'")).collect()
    assert one.near_next == 1 and one.near_edited == 1
