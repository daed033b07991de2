"""I-Match document fingerprints, with DataFrame functions only.

The lexicon holds the terms in a band of inverse document frequency, counted over all documents. Random subsets of it of
various sizes are drawn; for each, a document's distinct terms in the subset are sorted and hashed, so that a small
edit leaves some of the hashes as they are. Terms stand for their 64-bit hashes from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.store import keep

#: A term of the lexicon is in at least this share of the documents, and at most that; so a lexicon has at most
#: (terms of a mean document) / LEAST_SHARE terms, however many documents there are.
LEAST_SHARE, MOST_SHARE = 1 / 2000, 1 / 4
#: Subsets of the lexicon: the k-th keeps one term in RATES[k].
RATES = [2 ** (3 + k // 3) for k in range(24)]
#: What an empty list hashes to.
EMPTY = 42
MOST_BROADCAST = 1_000_000
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case runs of letters and digits."""
    hashes = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.xxhash64(x))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, total: int) -> DataFrame:
    """``term, subsets`` (a bit for each subset that keeps the term): the terms in the band that some subset keeps."""
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counts.where((F.col("n") >= F.lit(max(2.0, total * LEAST_SHARE))) & (F.col("n") <= F.lit(max(2.0, total * MOST_SHARE))))
    bits = [F.when(F.pmod(F.xxhash64(F.lit(k), F.col("term")), F.lit(rate)) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, rate in enumerate(RATES)]
    subsets = bits[0].cast("long")
    for bit in bits[1:]:
        subsets = subsets.bitwiseOR(bit.cast("long"))
    return keep(band.select("term", subsets.alias("subsets")).where("subsets <> 0"), "lexicon")


def _digits(hashed: Column) -> Column:
    return F.lower(F.lpad(F.hex(hashed), 16, "0"))


def fingerprint(found: Column, whole: Column) -> Column:
    """Eight digits for each subset, a dash where no term is in it; before them ``whole``, if all are dashes.

    ``found`` are sorted (term, subsets). A text without terms in any subset is told by the hash of all its terms.
    """
    def subset(k: int) -> Column:
        some = F.filter(found, lambda x: x["subsets"].bitwiseAND(F.lit(1 << k)) != 0)
        hashed = F.nullif(F.xxhash64(F.transform(some, lambda x: x["term"])), F.lit(EMPTY).cast("long"))
        return F.coalesce(F.substring(_digits(hashed), 1, 8), F.lit("-"))

    first = F.when(F.size(found) > 0, F.lit("")).otherwise(_digits(whole))
    return F.concat_ws(".", first, *(subset(k) for k in range(len(RATES))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either; 1 for equal fingerprints."""
    pairs = F.arrays_zip(F.slice(F.split(a, "[.]"), 2, len(RATES)).alias("a"), F.slice(F.split(b, "[.]"), 2, len(RATES)).alias("b"))
    told = F.filter(pairs, lambda x: (x["a"] != "-") | (x["b"] != "-"))
    alike = F.size(F.filter(told, lambda x: x["a"] == x["b"]))
    return F.when(a == b, F.lit(1.0)).when(F.size(told) > 0, alike / F.size(told)).otherwise(F.lit(0.0))


def _next(keys: DataFrame) -> DataFrame:
    """``id, of, next_id, next_of``: the document behind each, by id; the first one behind the last.

    A range sort gives parts in order. Documents follow each other within their part; a table of one row for each part
    links the parts.
    """
    parts = keep(keys.repartitionByRange("id", "of").withColumn("part", F.spark_partition_id()), "parts")
    own = F.struct("id", "of")
    inside = parts.withColumn("after", F.lead(own).over(Window.partitionBy("part").orderBy("id", "of")))
    firsts = parts.groupBy("part").agg(F.min(own).alias("first"))
    order = Window.orderBy("part")
    linked = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("link"))
    after = F.coalesce("after", "link")
    return inside.join(F.broadcast(linked), "part").select("id", "of", after["id"].alias("next_id"), after["of"].alias("next_of"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each document.

    The edited text has its last quarter of code points (rounded down) replaced by as many from the start of the next
    document, or all of it if it is shorter. A null text is empty. Rows equal in id and text are one document and come
    once; a null id comes first. A single document is its own next one. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(id_col), text).alias("of"), text.alias("text"))
    keys = docs.select("id", "of", F.length("text").alias("n")).distinct()
    total = keys.count()
    words = lexicon(docs, total)
    words = F.broadcast(words) if words.count() <= MOST_BROADCAST else words
    after = keep(_next(keys.select("id", "of")), "next")
    wants = after.join(keys, ["id", "of"]).select(F.col("next_id").alias("id"), F.col("next_of").alias("of"), F.col("id").alias("by_id"), F.col("of").alias("by_of"),
                                                  F.floor(F.col("n") / 4).cast("int").alias("take"))
    heads = docs.join(wants, ["id", "of"]).select(F.col("by_id").alias("id"), F.col("by_of").alias("of"), "take", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"))
    both = docs.join(heads, ["id", "of"]).dropDuplicates(["id", "of"]).select(
        "id", "of", "text", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("take")), "head").alias("edited"))
    versions = both.select("id", "of", F.posexplode(F.array("text", "edited")).alias("version", "text"))
    every = terms(F.col("text"))
    split = versions.select("id", "of", "version", F.length("text").alias("n_chars"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), every.alias("every"))
    # A null term keeps each version, whatever the lexicon has of it.
    hits = split.select("id", "of", "version", "n_chars", "sha", F.xxhash64("every").alias("whole"), F.explode(F.concat("every", F.array(F.lit(None).cast("long")))).alias("term")) \
        .join(words, "term", "left").where("subsets is not null or term is null")
    found = hits.groupBy("id", "of", "version", "n_chars", "sha", "whole").agg(
        F.array_sort(F.collect_list(F.when(F.col("subsets").isNotNull(), F.struct("term", "subsets")))).alias("found"))
    done = found.select("id", "of", "version", "n_chars", F.lower(F.hex("sha")).alias("sha"), fingerprint(F.col("found"), F.col("whole")).alias("print"))

    def of(version: int, name: str) -> Column:
        return F.max(F.when(F.col("version") == version, F.col(name)))

    prints = keep(done.groupBy("id", "of").agg(of(0, "n_chars").alias("n_chars"), of(1, "sha").alias("edited_sha256"), of(0, "print").alias("fingerprint"),
                                               of(1, "print").alias("edited_fingerprint")), "fingerprints")
    following = prints.select(F.col("id").alias("next_id"), F.col("of").alias("next_of"), F.col("fingerprint").alias("next_fingerprint"))
    return prints.join(after, ["id", "of"]).join(following, ["next_id", "next_of"]).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
