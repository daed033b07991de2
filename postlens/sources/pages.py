"""Fields from raw page HTML, by ordered extraction rules.

A rule is a pattern over the page (or its url); the rules of a field compile to
one ``coalesce`` in rule order, so a page is read once and stays in its row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.counts import metric_text, parse_count
from postlens.functions.links import post_id
from postlens.functions.records import comment_records
from postlens.functions.text import comment_body, first_non_blank, longest_fragment, pack_comments
from postlens.schema import POST_COLUMNS, POST_ID_PATTERN

METRICS = ("likes", "comments", "saves")


@dataclass(frozen=True)
class ExtractionRule:
    field: str
    priority: int
    pattern: str
    group: int = 1
    source: str = "html"

    #: Markup, in lower case, that a page must hold for the pattern to match; none means any page.
    marker: str | None = None

    def column(self) -> Column:
        return F.regexp_extract(F.col(self.source), self.pattern, self.group)


def _opening(attribute: str, value: str, contains: bool = False, tag: str | None = None) -> str:
    """Opening tag, its name in group 1, whose attribute equals (or contains) the value."""
    inner = f'[^"]*{re.escape(value)}[^"]*' if contains else re.escape(value)
    return rf'<({tag or chr(92) + "w+"})\b(?=[^>]*\b{attribute}="{inner}")[^>]*>'


def _inside(tag: Column, rest: Column) -> Column:
    """Markup up to the closing tag that matches an opening one just before ``rest``.

    Tags of the same name are counted in and out; without a match all of ``rest``
    belongs to the element.
    """
    same = F.concat(F.lit("(?i)</?"), tag, F.lit(r"\b[^>]*>"))
    tags, pieces = F.regexp_extract_all(rest, same, F.lit(0)), F.split(rest, same, -1)
    step = F.transform(tags, lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"))
    # ``seen`` counts the tags before the one that brings the depth to nothing.
    stop = F.reduce(step, start, lambda s, x: F.when(s["depth"] <= 0, s).otherwise(F.struct(
        (s["depth"] + x).alias("depth"), (s["seen"] + F.when(s["depth"] + x > 0, 1).otherwise(0)).alias("seen"))))["seen"]
    taken = F.zip_with(F.slice(pieces, F.lit(1), stop + 1), F.slice(tags, F.lit(1), stop), lambda piece, t: F.concat(piece, F.coalesce(t, F.lit(""))))
    return F.array_join(taken, "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def _nested(html: Column, opening: str, tag: str) -> Column:
    """Markup inside each element of one tag with this opening, from an index of the tag's places.

    The markup is cut once at all tags of that name. ``depth`` is how many are open behind each, so an element ends at the first
    later tag that leaves one fewer than its own; without one it takes all that follows.
    """
    same = F.lit(rf"(?i)</?{tag}\b[^>]*>")
    index = F.struct(F.regexp_extract_all(html, same, F.lit(0)).alias("tags"), F.split(html, same, -1).alias("pieces"))

    def with_depth(x: Column) -> Column:
        step = F.transform(x["tags"], lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1))
        none = F.array().cast("array<int>")
        depth = F.reduce(step, none, lambda d, s: F.concat(d, F.array(F.coalesce(F.get(d, F.size(d) - 1), F.lit(0)) + s)))
        return F.struct(x["tags"].alias("tags"), x["pieces"].alias("pieces"), depth.alias("depth"))

    def inside(x: Column) -> Column:
        openings = F.filter(F.transform(x["tags"], lambda t, i: F.when(t.rlike(f"(?is)^{opening}$"), i)), lambda i: i.isNotNull())

        def markup(i: Column) -> Column:
            ends = F.array_position(F.slice(x["depth"], i + 2, F.size(x["depth"])), x["depth"][i] - 1).cast("int")
            between = F.when(ends > 0, ends - 1).otherwise(F.size(x["tags"]) - i - 1)
            return F.array_join(F.zip_with(F.slice(x["pieces"], i + 2, between + 1), F.slice(x["tags"], i + 2, between),
                                           lambda piece, t: F.concat(piece, F.coalesce(t, F.lit("")))), "")

        return F.transform(openings, markup)

    return _bound(index, lambda x: _bound(with_depth(x), inside))


def _elements(html: Column, opening: str, nested: bool = False) -> Column:
    """Markup inside each element with this opening tag, in page order.

    The page is cut at the opening tags. Where such elements hold each other (``nested``),
    each is looked for in all that follows it; else only up to the next one.
    """
    tag = re.match(r"<\((\w+)\)\\b", opening)
    if nested and tag:
        return _nested(html, opening, tag[1])
    pattern = F.lit(f"(?is){opening}")
    names, opened, pieces = (F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(0)), F.split(html, pattern, -1))
    behind = F.slice(pieces, F.lit(2), F.size(names))
    if nested:
        follow = F.zip_with(behind, F.concat(F.slice(opened, F.lit(2), F.size(names)), F.array(F.lit(""))), lambda x, o: F.concat(x, o))
        behind = F.transform(follow, lambda x, i: F.array_join(F.slice(follow, i + 1, F.size(follow)), ""))
    return F.zip_with(names, behind, _inside)


@dataclass(frozen=True)
class ElementRule:
    """Text inside the first element with an opening tag, whatever it nests."""

    field: str
    priority: int
    opening: str
    marker: str | None = None

    def column(self) -> Column:
        rest = F.regexp_extract(F.col("html"), f"(?is){self.opening}(.*)$", 2)
        return _inside(F.regexp_extract(F.col("html"), f"(?is){self.opening}", 1), rest)


def _marker(attribute: str, value: str, contains: bool) -> str:
    """What a page must hold, in lower case, for a rule on this attribute to match."""
    return value.lower() if contains else f'{attribute}="{value}"'.lower()


def element_text(field: str, attribute: str, value: str, contains: bool = False, tag: str | None = None) -> ElementRule:
    """Text inside the first element (of a tag) whose attribute equals (or contains) the value."""
    return ElementRule(field, 0, _opening(attribute, value, contains, tag), _marker(attribute, value, contains))


def element_attribute(field: str, attribute: str, value: str, wanted: str,
                      contains: bool = False, tag: str | None = None) -> ExtractionRule:
    """Another attribute of the first element (of a tag) whose attribute equals (or contains) the value."""
    inner = f'[^"]*{re.escape(value)}[^"]*' if contains else re.escape(value)
    pattern = rf'(?is)<{tag or chr(92) + "w+"}\b(?=[^>]*\b{attribute}="{inner}")[^>]*?\b{wanted}="([^"]*)"'
    return ExtractionRule(field, 0, pattern, 1, marker=_marker(attribute, value, contains))


def sibling_text(field: str, tag: str, attribute: str, value: str, sibling: str) -> ExtractionRule:
    """Text inside the element of one tag that stands right behind one with this attribute."""
    return ExtractionRule(field, 0, rf'(?is)<{tag}\b(?=[^>]*\b{attribute}="{re.escape(value)}")[^>]*>(?:(?!</{tag}).)*</{tag}\s*>\s*<{sibling}\b[^>]*>(.*?)</{sibling}\s*>', 1,
                          marker=_marker(attribute, value, False))


Rule = ExtractionRule | ElementRule


def numbered(rules: Sequence[Rule]) -> list[Rule]:
    return [replace(r, priority=i) for i, r in enumerate(rules)]


# Page markers in order of trust, as (attribute, value, contains, tag).
METRIC_MARKERS = {
    "likes": (
        ("data-e2e", "like-count", False, None), ("data-e2e", "browse-like-count", False, None),
        ("title", "like", True, None), ("aria-label", "like", True, None),
        ("data-e2e", "like", True, "span"), ("data-e2e", "like", True, "strong"),
    ),
    "comments": (
        ("data-e2e", "comment-count", False, None), ("data-e2e", "browse-comment-count", False, None),
        ("title", "comment", True, None), ("aria-label", "comment", True, None),
        ("data-e2e", "comment", True, "span"), ("data-e2e", "comment", True, "strong"),
    ),
    "saves": (
        ("data-e2e", "undefined-count", False, None), ("data-e2e", "share-count", False, None),
        ("data-e2e", "save-count", False, None), ("title", "share", True, None), ("title", "save", True, None),
        ("data-e2e", "share", True, "span"), ("data-e2e", "save", True, "span"),
        ("data-e2e", "share", True, "strong"), ("data-e2e", "save", True, "strong"),
    ),
}
# An element behind one of these holds the likes, as (tag, attribute, value, sibling).
LIKE_SIBLINGS = (("svg", "fill", "#ff0050", "strong"), ("svg", "fill", "#FE2C55", "strong"))
CAPTION_MARKERS = (
    ("data-e2e", "browse-video-desc", False), ("data-e2e", "video-desc", False),
    ("class", "video-meta-caption", True),
)


@dataclass(frozen=True)
class CommentRule:
    """Where a page has its comments: ``opening`` is the opening tag of a comment block
    (its name in group 1), ``fragment`` that of its inner pieces, of which the longest is the
    comment text. With a ``limit`` a page gives so many comments at most."""

    opening: str
    fragment: str = r"<(span)\b[^>]*>"
    limit: int | None = None


# Fixed value: the marker of a top-level comment.
DEFAULT_COMMENTS = CommentRule(_opening("data-e2e", "comment-level-1"))


def default_metric_rules() -> list[Rule]:
    rules = []
    for field, markers in METRIC_MARKERS.items():
        for attribute, value, contains, tag in markers:
            rules.append(element_text(field, attribute, value, contains, tag))
            rules.append(element_attribute(field, attribute, value, "title", contains, tag))
            rules.append(element_attribute(field, attribute, value, "aria-label", contains, tag))
        if field == "likes":
            rules += [sibling_text(field, *x) for x in LIKE_SIBLINGS]
    return numbered(rules)


def default_caption_rules() -> list[Rule]:
    return numbered([element_text("caption", *m) for m in CAPTION_MARKERS])


def inner_text(c: Column) -> Column:
    """Markup text without tags, with the common entities decoded."""
    text = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def block_text(c: Column) -> Column:
    """Markup text with a line break where a line or a block ends."""
    return inner_text(F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li)>", "\n"))


def extract_comments(rule: CommentRule) -> Column:
    """Comment texts of a page, in page order: the real line of each block, each text
    once. Row-local, as a page holds its own comments."""
    def comment(block: Column) -> Column:
        pieces = F.transform(_elements(block, rule.fragment, nested=True), block_text)
        return comment_body(longest_fragment(pieces, block_text(block)))

    found = F.filter(F.transform(_elements(F.col("html"), rule.opening), comment), lambda x: x.isNotNull())
    found = F.array_distinct(found)
    return F.slice(found, 1, rule.limit) if rule.limit else found


def _first(rules: Sequence[Rule], field: str, read: Callable[[Column], Column]) -> Column:
    """The first value that is not blank, by the field's rules in their order.

    A rule's pattern runs over a page only if the page holds the rule's marker, which a plain search tells.
    """
    chosen = sorted((r for r in rules if r.field == field), key=lambda r: r.priority)

    def values(low: Column) -> Column:
        return first_non_blank([read(inner_text(r.column() if r.marker is None else F.when(low.contains(r.marker), r.column()).otherwise(F.lit(""))))
                                for r in chosen])

    if any(r.marker is not None for r in chosen):
        return _bound(F.lower(F.col("html")), values)
    return values(F.lit(""))


def extract_caption(rules: Sequence[Rule]) -> Column:
    return _first(rules, "caption", lambda text: text)


def with_metrics(pages: DataFrame, rules: Sequence[Rule],
                 compat: bool = False) -> DataFrame:
    """Adds raw and parsed counts, and ``metrics_source``.

    Metrics no rule finds are filled from the bold numbers of the page, by
    position: first likes, then comments, then saves.
    """
    named = {
        f"raw_{m}": _first(rules, m, lambda text: metric_text(text, compat))
        for m in METRICS
    }
    bold = F.regexp_extract_all(
        F.col("html"), F.lit(r"(?s)<strong\b[^>]*>\s*(\d+[KMB]?)\s*</strong>"), F.lit(1)
    )
    found = pages.withColumns({**named, "_bold": bold})
    filled = {
        f"raw_{m}": F.coalesce(
            F.nullif(F.col(f"raw_{m}"), F.lit("")), F.get("_bold", F.lit(i)), F.lit("")
        )
        for i, m in enumerate(METRICS)
    }
    missing = [F.col(f"raw_{m}") == "" for m in METRICS]
    by_position = F.lit(False)
    for i, blank in enumerate(missing):
        by_position = by_position | (blank & (F.size("_bold") > i))
    return (
        found.withColumns({**filled, "metrics_source": F.when(by_position, "position").otherwise("rule")})
        .drop("_bold")
        .withColumns({m: parse_count(F.col(f"raw_{m}")) for m in METRICS})
    )


def pages_to_posts(pages: DataFrame, caption_rules: Sequence[Rule] | None = None,
                   metric_rules: Sequence[Rule] | None = None,
                   comment_rule: CommentRule | None = DEFAULT_COMMENTS,
                   id_pattern: str = POST_ID_PATTERN, compat: bool = False,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Post rows from ``pages(url, html)``; pages whose url has no id are skipped.

    Works on batch and streaming input. ``keep`` names page columns to carry
    along, such as an arrival order. Without a ``comment_rule`` no comments are taken.
    """
    posts = pages.withColumns({
        "video_id": post_id(F.col("url"), id_pattern),
        "caption": extract_caption(caption_rules or default_caption_rules()),
    }).where(F.col("video_id").isNotNull())
    texts = extract_comments(comment_rule) if comment_rule else F.array().cast("array<string>")
    posts = with_metrics(posts, metric_rules if metric_rules is not None else default_metric_rules(), compat)
    posts = posts.withColumns({"_comments": texts, "timestamp": F.current_timestamp()}).withColumns({
        "video_url": F.col("url"),
        "comment_text": pack_comments(F.col("_comments")),
        "comment_count_extracted": F.size("_comments"),
        "comments_data": comment_records(F.col("_comments"), F.col("timestamp")),
    })
    return posts.select(*POST_COLUMNS, "metrics_source", *keep)
