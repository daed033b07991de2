"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are within one edit if they are equal, if both lose the same character position and become equal, or if one
loses a character and becomes the other. So every line emits the hashes of its variants, lines with an equal hash are
joined, and the edit distance is verified on their texts.

Most lines have no partner, and a line has as many variants as characters. One edit leaves one half of a line as it
is, and all of its eighths but one; so only lines that share a half with another, and then all but an eighth, emit
variants, and only those that lose a character of that eighth. Long eighths are cut into eighths in turn. This leaves
no pair out, and a variant costs no more than the piece that it is cut from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import keep, same

#: Shorter lines are compared for equality only: one edit makes another word of them. A parameter of ``dedup_lines``.
NEAR_FROM = 16
SEGMENTS = 8
#: Segments with more characters are cut again before variants are made.
WIDE = 128


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often a function in ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of both ends of a line, as long as half of it and half of a line shorter by one."""
    halves = F.array_distinct(F.array((n / 2).cast("int"), ((n - 1) / 2).cast("int")))
    return F.flatten(F.transform(halves, lambda s: F.array(
        F.xxhash64(F.lit("first"), s, F.substring(line, F.lit(1), s)), F.xxhash64(F.lit("last"), s, F.substring(line, n - s + 1, s)))))


def _segment(line: Column, n: Column, m: Column, parts: Column, j: Column) -> Column:
    """Segment ``j`` of ``parts`` of a line, cut as in a line of length ``m``, which is ``n`` or one less: its text and the hash of all around it."""
    low, high = (j.cast("long") * m / parts).cast("int"), ((j.cast("long") + 1) * m / parts).cast("int")
    key = F.xxhash64(m, parts, j, F.substring(line, F.lit(1), low), F.substring(line, n - (m - high) + 1, m - high))
    return F.struct(m.alias("m"), j.alias("j"), (m < n).alias("longer"), low.alias("low"), key.alias("key"),
                    F.substring(line, low + 1, n - (m - high) - low).alias("middle"))


def _variants(middle: Column, low: Column, key: Column, longer: Column) -> Column:
    """Hashes by kind, with the place lost: S of a line of the same length, D of the longer of two, F the shorter's full segment, to meet a D."""
    def without(i: Column) -> Column:
        return F.concat(F.substring(middle, F.lit(1), i - 1), F.substring(middle, i + 1, F.length(middle)))

    def tagged(kind: str, i: Column, key: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(kind).alias("kind"), (low + i).alias("place"))

    places = F.filter(F.sequence(F.lit(0), F.length(middle)), lambda i: i > 0)
    lost = F.transform(places, lambda i: tagged("D", i, F.xxhash64(key, F.lit("D"), without(i))))
    same_length = F.transform(places, lambda i: tagged("S", i, F.xxhash64(key, F.lit("S"), i, without(i))))
    return F.when(longer, lost).otherwise(F.concat(same_length, F.array(tagged("F", F.lit(0), F.xxhash64(key, F.lit("D"), middle)))))


def _one_edit(kind: Column, text: Column, place: Column, other: Column, other_place: Column) -> Column:
    """Whether the edit at the shared place is the only difference: linear in the lines' length."""
    def cut(line: Column, p: Column) -> Column:
        return F.concat(F.substring(line, F.lit(1), p - 1), F.substring(line, p + 1, F.length(line)))

    return F.when(kind == "S", cut(text, place) == cut(other, place)).when(kind == "D", cut(text, place) == other).otherwise(text == cut(other, other_place))


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose ``key`` another row has too. The keys are written first, so that Spark can split a common key's rows."""
    keys = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), name)
    return rows.join(keys, "key", "left_semi")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row whole, with its id and a hash of id and text: rows equal in both are one document."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"),
                     F.xxhash64(F.col(id_col), F.col(text_col)).alias("of"), F.col(text_col).alias("text"))


def _near(first: DataFrame, docs: DataFrame, near_from: int) -> DataFrame:
    """Places of lines that an earlier line is within one edit of."""
    halves = first.where(F.col("n") >= near_from).select("at", F.explode("keys").alias("key"))
    some = _shared(halves, "half_keys").select("at").distinct().groupBy(F.col("at.id").alias("in_id"), F.col("at.of").alias("in_of")) \
        .agg(F.collect_list("at.line").alias("wanted"))
    wanted = _bound(_lines(F.col("text")), lambda lines: F.transform("wanted", lambda i: F.struct(
        i.alias("line"), F.trim(F.element_at(lines, i + 1)).alias("text"))))
    texts = keep(docs.select("id", "of", "text").join(some, same(F.col("id"), F.col("in_id")) & (F.col("of") == F.col("in_of")))
                 .select("id", "of", F.explode(wanted).alias("x"))
                 .select(F.struct("id", "of", F.col("x.line").alias("line")).alias("at"), F.col("x.text").alias("text"))
                 .dropDuplicates(["at"]), "near_lines")
    n = F.length("text")
    lengths = texts.select("at", "text", F.explode(F.array(n, n - 1)).alias("m"))

    def cut(rows: DataFrame, parts: int) -> DataFrame:
        segments = rows.select("at", F.explode(F.transform("js", lambda j: _segment(F.col("text"), n, F.col("m"), F.lit(parts), j))).alias("x"))
        return keep(_shared(segments.select("at", "x.*"), "segment_keys"), "segments")

    parts, done = SEGMENTS, []
    open_segments = cut(lengths.withColumn("js", F.sequence(F.lit(0), F.lit(parts - 1))), parts)
    while True:
        # Both lines of a pair are cut alike: what is wide follows from the length that the segment is cut by.
        wide = F.col("m") > WIDE * parts
        done.append(open_segments.where(~wide))
        again = open_segments.where(wide)
        if again.isEmpty():
            break
        parts *= SEGMENTS
        inner = F.sequence(F.col("j") * SEGMENTS, F.col("j") * SEGMENTS + SEGMENTS - 1)
        open_segments = cut(again.select("at", "m", inner.alias("js")).join(texts, "at"), parts)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    variants = found.select("at", F.explode(_variants(F.col("middle"), F.col("low"), F.col("key"), F.col("longer"))).alias("x")).select("at", "x.*")
    equal = keep(_shared(variants, "variant_keys"), "equal_variants")
    earliest = keep(equal.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, F.struct("at", "place"))).alias(k) for k in "SDF")), "earliest")
    other = F.when(F.col("kind") == "S", F.col("S")).when(F.col("kind") == "F", F.col("D")).otherwise(F.col("F"))
    pairs = equal.join(earliest, "key").select("at", "kind", "place", other.alias("other")).where("other.at < at") \
        .select("at", "kind", F.col("other.at").alias("other"), F.struct("place", F.col("other.place").alias("other_place")).alias("places")) \
        .groupBy("at", "other", "kind").agg(F.min("places").alias("places"))
    both = pairs.join(texts, "at").join(texts.select(F.col("at").alias("other"), F.col("text").alias("other_text")), "other")
    verified = _one_edit(F.col("kind"), F.col("text"), F.col("places.place"), F.col("other_text"), F.col("places.other_place"))
    return both.where(verified).select("at").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_from: int = NEAR_FROM) -> DataFrame:
    """``row`` (a row of ``df`` with repeated lines taken out of its text), ``n_lines`` and ``n_kept`` (lines before and after).

    Lines end at a line feed and are compared without spaces around them. Of equal lines the earliest stays, by id, hash of
    the text and place. A line of ``near_from`` or more characters (0: any line) also goes if an earlier one of as many is
    within one edit of it, whether that one stays or not. Lines kept are unchanged; blank lines always stay. A text that loses
    all its lines is empty; a null text stays null, with no lines. Rows with equal id and text are one document and have the
    same result; null ids come first. Other columns are passed on; an empty table gives no rows.
    """
    docs = _documents(df, id_col, text_col)
    split = docs.select("id", "of", F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.trim(x))).alias("line", "text")).where("text <> ''")
    n = F.length("text")
    hashed = split.select(F.struct("id", "of", "line").alias("at"), n.alias("n"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g"),
                          F.when(n >= near_from, _half_keys(F.col("text"), n)).alias("keys"))
    first = keep(hashed.groupBy("h", "g").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys")).drop("h", "g"), "first_lines")
    near = keep(_near(first, docs, near_from), "near_places")
    kept = first.select("at").join(near, "at", "left_anti").groupBy(F.col("at.id").alias("in_id"), F.col("at.of").alias("in_of")) \
        .agg(F.collect_list("at.line").alias("stay"))

    def rebuilt(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
        stay = F.array_sort(F.concat(F.coalesce("stay", F.array().cast("array<int>")), blank))
        return F.struct(F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n").alias("text"), F.size(lines).alias("n_lines"),
                        F.size(stay).alias("n_kept"))

    out = docs.join(kept, same(F.col("id"), F.col("in_id")) & (F.col("of") == F.col("in_of")), "left") \
        .select("row", F.when(F.col("text").isNotNull(), _bound(_lines(F.col("text")), rebuilt)).alias("done"))
    return out.select(F.col("row").withField(f"`{text_col}`", F.col("done.text")).alias("row"),
                      F.coalesce("done.n_lines", F.lit(0)).alias("n_lines"), F.coalesce("done.n_kept", F.lit(0)).alias("n_kept"))
