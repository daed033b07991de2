"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import bpe, fingerprints, langid, licenses, lines, packing, repair, secretscan, simhash, spelling, suffixes, tokenfile, vectors
from postlens.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_imatch(spark, sf_dir):
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


@query
def op2_near_vectors(spark, sf_dir):
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op3_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"), "row.text")


@query
def op4_bpe(spark, sf_dir):
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


@query
def op5_token_file(spark, sf_dir):
    path = work_path(spark, "token_file")
    tokenfile.write_token_file(_table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenfile.check_token_file(spark, path)


@query
def op6_license_scan(spark, sf_dir):
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


@query
def op7_repeated_passages(spark, sf_dir):
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark, sf_dir):
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, bits=64, differences=3)


@query
def op9_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, size=2048)


@query
def op10_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_text_model(docs)
    return langid.identify(docs, model, declared_col="lang", host_col="source", id_col="doc_id").withColumnRenamed("row", "doc_id")


@query
def op11_secret_scan(spark, sf_dir):
    found = secretscan.secret_scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def of(kind):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op12_spelling_groups(spark, sf_dir):
    words = spelling.damaged_words(_table(spark, sf_dir, "documents"), least_length=spelling.LEAST_LENGTH)
    return spelling.spelling_groups(words)


@query
def op13_conversation_repair(spark, sf_dir):
    found = repair.repair_conversations(repair.damaged(_table(spark, sf_dir, "conversations")))
    return found.where("last").drop("piece", "last", "repaired")


@query
def language_id_pages(spark, sf_dir):
    pages = langid.page_evidence(_table(spark, sf_dir, "pages"))
    model = langid.fit_text_model(_table(spark, sf_dir, "documents"))
    return langid.identify(pages, model, declared_col="declared", host_col="host", suffix_col="suffix", id_col="page_id").withColumnRenamed("row", "page_id")


ORACLE["op2_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
heads AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT m.vec_id, (SELECT count(*) FROM links WHERE a = m.vec_id) AS n_links, h.component_id, h.component_id = m.vec_id AS kept
FROM embeddings m JOIN heads h ON h.node = m.vec_id
"""

ORACLE["op3_line_dedup"] = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS raw, trim(ls[i], ' ') AS x, doc_id * 10000000 + i AS pos
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT x, min(pos) AS pos FROM l WHERE x <> '' GROUP BY x),
s AS (SELECT pos, p, hash(left(x, p - 1) || substring(x, p + 1)) AS v, length(x) AS n
      FROM (SELECT pos, x, unnest(range(1, length(x) + 1)) AS p FROM f WHERE length(x) >= 16)),
lost_same_place AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY p, v) AS least FROM s) WHERE pos > least),
lost_shorter AS (SELECT greatest(s.pos, f.pos) AS pos FROM s JOIN f ON hash(f.x) = s.v AND length(f.x) = s.n - 1 AND length(f.x) >= 16),
gone AS (SELECT pos FROM lost_same_place UNION SELECT pos FROM lost_shorter),
kept AS (SELECT pos FROM f WHERE pos NOT IN (SELECT pos FROM gone))
SELECT d.doc_id, max(len(d.ls))::BIGINT AS n_lines, count(l.i)::BIGINT AS n_kept, coalesce(string_agg(l.raw, chr(10) ORDER BY l.i), '') AS text
FROM d LEFT JOIN l ON l.doc_id = d.doc_id AND (l.x = '' OR l.pos IN (SELECT pos FROM kept))
GROUP BY d.doc_id
"""
