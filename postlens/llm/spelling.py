"""Spelling variants: a trie over letter-group counts, searched with a budget of one surplus and one deficit.

A word's vector is its number of letters in each of a few groups. One edit adds a letter to a group (surplus), takes one from
a group (deficit), or both, so a search that walks the groups one after the other may overspend either by one at most.
The upper levels of the trie are a table: each level splits the nodes that still hold many words, and the searches that can
reach a node are sent to it. Below, each node's words make a trie in memory, walked depth first; the words of the leaves
reached are verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import forget, keep, texts, worker_path

# Letters of a word, the divisor that picks a run for a deletion, least length and count, ratio of a form.
LETTERS = "[A-Za-z\u00c0-\u00ff]"
DIVISOR, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Groups of about equal weight in European prose; letters in none of them count as the last level, a group of their own.
GROUPS = ("e", "t", "a", "n", "io", "rs", "hd", "lcu", "mwfgy", "pbvk")
#: Words of a node that a task holds as a trie; larger nodes are split by the next level.
NODE_WORDS = 60_000
#: Searches that go to one task of a node; more are dealt over several, each with the node's words.
NODE_SEARCHES = 20_000
#: Partitions of the search; beyond, several places share a task, one after the other.
MOST_TASKS = 10_000


def damaged_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, least_length: int = 1) -> DataFrame:
    """``word``: one row for each maximal run of ``least_length`` letters or more, A-Z lower-cased, of which a fixed share has lost a letter.

    With ``h`` the CRC-32 of ``<id>:<run>``, runs whose ``h`` the divisor divides lose the code point at ``h % length``. A null
    text has no runs; a null id reads as an empty string. Empty results are left out.
    """
    source = texts(df, id_col, text_col)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = source.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                         F.explode(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("run")).alias("word")).where("word <> ''")


def _vector(word: Column) -> Column:
    """Letters in each group, and those in none."""
    def count(letters: str) -> Column:
        return F.length(word) - F.length(F.translate(word, letters, ""))

    counts = [count(g) for g in GROUPS]
    return F.array(*counts, F.length(word) - reduce(lambda a, b: a + b, counts))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def _insert(trie: dict, word: str, levels: list[int]) -> None:
    for c in levels[:-1]:
        trie = trie.setdefault(c, {})
    trie.setdefault(levels[-1], []).append(word)


def _search(trie: dict, levels: list[int], spent: int) -> list[str]:
    """Words of all leaves that can be reached; ``spent`` is 0, 1 (the surplus) or 2 (the deficit too).

    The deficit may be spent behind the surplus only: of two words that owe each other a letter, one finds the other.
    """
    found: list[str] = []
    left = [(trie, 0, spent)]
    while left:
        node, depth, spent = left.pop()
        for c in levels[depth:]:
            depth += 1
            if spent < 2:
                other = node.get(c - 1 if spent else c + 1)
                if other is not None:
                    left.append((other, depth, spent + 1))
            node = node.get(c)
            if node is None:
                break
        else:
            found += node
    return found


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``place, depth, spent, word, levels`` sorted so that a place's own words (spent null) come before its searches."""
    place, trie = None, {}
    for batch in batches:
        a, b = [], []
        vectors = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1).tolist()
        for where, depth, spent, word, levels in zip(*(c.to_pylist() for c in batch.columns[:4]), vectors, strict=True):
            if where != place:
                place, trie = where, {}
            levels = levels[depth:] or [0]
            if spent is None:
                _insert(trie, word, levels)
                continue
            for x in _search(trie, levels, spent):
                if one_edit(word, x):
                    a.append(word)
                    b.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def near_pairs(words: DataFrame, node_words: int = NODE_WORDS, node_searches: int = NODE_SEARCHES) -> DataFrame:
    """``a, b`` with ``a < b``: all pairs of the distinct words in column ``word`` that are one edit apart.

    Both limits only say how the work is dealt; any value gives the same pairs. A node that still holds more words after the
    last level (all with equal vectors) is dealt in blocks, each of which sees every search of the node.
    """
    worker_path(words.sparkSession)
    own = keep(words.select("word", _vector(F.col("word")).alias("levels"), F.lit("").alias("node")), "spelling_words")
    search = own.select("*", F.lit(0).alias("spent"))
    done_own, done_search, copies, depth = [], [], [own], 0
    while depth <= len(GROUPS):
        large = keep(own.groupBy("node").count().where(F.col("count") > node_words).select("node"), "large_nodes")
        copies.append(large)
        if large.isEmpty():
            break
        done_own.append(own.join(large, "node", "left_anti").withColumn("depth", F.lit(depth)))
        done_search.append(search.join(large, "node", "left_anti").withColumn("depth", F.lit(depth)))
        value = F.col("levels")[depth]
        inside = own.join(large, "node", "left_semi")
        # One row for each child: the counts that occur at this level below a large node.
        children = inside.select("node", value.alias("c")).distinct()
        step = F.col("c") - value
        open_step = F.when(F.col("spent") == 0, 1).when(F.col("spent") == 1, -1)  # the surplus, then the deficit
        moved = search.join(children, "node").withColumn("spent", F.when(step == 0, F.col("spent")).when(step == open_step, F.col("spent") + 1)) \
            .where("spent is not null")
        own = keep(inside.select("word", "levels", F.concat("node", F.lit("."), value.cast("string")).alias("node")), "spelling_words")
        search = keep(moved.select("word", "levels", F.concat("node", F.lit("."), F.col("c").cast("string")).alias("node"), "spent"), "spelling_searches")
        copies += [own, search]
        depth += 1
    done_own.append(own.withColumn("depth", F.lit(depth)))
    done_search.append(search.withColumn("depth", F.lit(depth)))
    own, search = reduce(DataFrame.unionByName, done_own), reduce(DataFrame.unionByName, done_search)

    def deals(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy("node").count().select("node", F.ceil(F.col("count") / most).cast("int").alias(name))

    blocks = deals(own, node_words, "blocks").join(deals(search, node_searches, "parts"), "node")
    blocks = keep(blocks, "spelling_blocks")
    copies.append(blocks)
    places = blocks.agg(F.sum(F.col("blocks") * F.col("parts")).alias("n")).first()["n"] or 1

    def placed(rows: DataFrame, mine: str, others: str) -> DataFrame:
        share = F.pmod(F.xxhash64("word"), F.col(mine)).cast("int")
        block, part = (share, F.col("x")) if mine == "blocks" else (F.col("x"), share)
        return rows.join(blocks, "node").withColumn("x", F.explode(F.sequence(F.lit(0), F.col(others) - 1))) \
            .withColumn("place", F.concat_ws("/", "node", block.cast("string"), part.cast("string")))

    columns = ["place", "depth", "spent", "word", "levels"]
    rows = placed(own.withColumn("spent", F.lit(None).cast("int")), "blocks", "parts").select(*columns).unionByName(placed(search, "parts", "blocks").select(*columns))
    found = rows.repartition(min(places, MOST_TASKS), "place").sortWithinPartitions("place", F.col("spent").isNotNull()).mapInArrow(_pairs, "a string, b string")
    # Words with equal vectors find each other; all others are found once.
    twice = _vector(F.col("a")) == _vector(F.col("b"))
    out = keep(found.where(~twice | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "spelling_pairs")
    forget(*copies)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: each round doubles the part of a chain that is followed."""
    at = keep(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = keep(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
                    "spelling_roots")
        forget(at)
        if step.where("moved").isEmpty():
            return step.drop("moved")
        at = step.drop("moved")
        at._kept_at = step._kept_at


def spelling_groups(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for rows of ``word``.

    Words of ``least_length`` code points that occur ``least_count`` times are compared. Two are near if one insertion, deletion
    or replacement of a code point makes one of the other. A word's form is its near word of largest ``n`` (the smallest in
    code-point order of several), if that is at least ``ratio`` times its own; ``root`` follows forms to the last. Null words
    are left out; an empty table gives no rows. With a ratio of 1 or less chains could turn in circles, so it is refused.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    counted = keep(words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count),
                   "spelling_counts")
    pairs = near_pairs(counted)
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(counted.withColumnRenamed("word", "b"), "b") \
        .groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    judged = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    judged = keep(judged.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "spelling_forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
