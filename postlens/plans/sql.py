"""Common parts of the check queries (DuckDB dialect)."""

from __future__ import annotations

from postlens.plans import testbed as T

# Fixed values, stated here once more so that a slip in the package's own shows.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
STOP_WORDS = """
a about above after again against ain all am an and any are aren as at be because been before being below between both but by
can couldn did didn do does doesn doing don down during each few for from further had hadn has hasn have haven having he her here
hers herself him himself his how i if in into is isn it its itself just ll m ma me mightn more most mustn my myself needn no nor
not now of off on once only or other our ours ourselves out over own re s same shan she should shouldn so some such t than that
the their theirs them themselves then there these they this those through to too under until up ve very was wasn we were weren
what when where which while who whom why will with won wouldn y you your yours yourself yourselves d o
tiktok video gta gta6 game gaming like get would could really one go see know think good bad way time make come want need
""".split()
TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}"
MARKUP = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(e: str) -> str:
    e = f"regexp_replace(lower(coalesce({e}, '')), '(http|www)[^{SPACE}]+', '', 'g')"
    e = f"regexp_replace({e}, '[@#][{WORD}]+', '', 'g')"
    e = f"regexp_replace({e}, '[^a-zA-Z{SPACE}]', '', 'g')"
    return f"trim(regexp_replace({e}, '[{SPACE}]+', ' ', 'g'))"


def inner_text(e: str) -> str:
    e = f"regexp_replace({e}, '<[^>]*>', '', 'g')"
    for entity, char in MARKUP:
        e = f"replace({e}, '{entity}', '{char}')"
    return e


_EMOTION_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EMOTION_OF_LANG.items())

POSTS = f"""
posts AS (
  SELECT d.doc_id AS video_id, d.text AS caption,
    CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive'
         WHEN l.toxic IS NOT NULL OR l.quality IS NOT NULL THEN 'Neutral' ELSE 'Unknown' END AS sentiment_label,
    CAST(d.n_chars % 1000 AS DOUBLE) / 1000.0 AS sentiment_confidence,
    CASE d.lang {_EMOTION_CASE} END AS caption_emotion,
    CAST(d.doc_id % 10 AS DOUBLE) / 10 AS caption_emotion_confidence,
    coalesce(e.n, 0) AS comments, e.ts AS "timestamp"
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l
    ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT user_id, count(*) AS n, min(ts) AS ts FROM events GROUP BY user_id) e
    ON e.user_id = d.doc_id
)"""

PACKED = """
packed AS (
  SELECT conv_id AS video_id, string_agg(text, ' ||| ' ORDER BY turn) AS comment_text
  FROM conversations GROUP BY conv_id
)"""


def lexicon(name: str, entries, labels) -> str:
    rows = ", ".join(f"('{lab}', {list(labels).index(lab)}, '{term}', {w})" for lab, term, w in entries)
    return f"{name}(label, label_pos, term, weight) AS (VALUES {rows})"


EMOTION_LEXICON = lexicon("emotion_lexicon", T.EMOTION_LEXICON, T.EMOTIONS)
SENTIMENT_LEXICON = lexicon("sentiment_lexicon", T.SENTIMENT_LEXICON, T.SENTIMENTS)


def scored(name: str, source: str, keys: str, text: str, lex: str, default: str) -> str:
    """CTEs ending in ``name(keys, label, confidence)`` for texts of ``source``."""
    using = f"USING ({keys})"
    return f"""
{name}_hits AS (
  SELECT {keys}, label, label_pos, sum(weight) AS w
  FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS term FROM {source})
  JOIN {lex} USING (term) GROUP BY {keys}, label, label_pos
),
{name}_best AS (
  SELECT {keys}, first(label ORDER BY w DESC, label_pos) AS label, max(w) / sum(w) AS confidence
  FROM {name}_hits GROUP BY {keys}
),
{name} AS (
  SELECT s.*, CASE WHEN trim(coalesce({text}, '')) = '' THEN 'Unknown' ELSE coalesce(b.label, '{default}') END AS label,
    CASE WHEN trim(coalesce({text}, '')) = '' THEN 0.0 ELSE coalesce(b.confidence, 0.0) END AS confidence
  FROM {source} s LEFT JOIN {name}_best b {using}
)"""


EMOTIONS_OF_COMMENTS = f"""{EMOTION_LEXICON},
turns AS (SELECT conv_id AS video_id, turn AS pos, text FROM conversations),
{scored("comment_scores", "turns", "video_id, pos", "text", "emotion_lexicon", T.EMOTION_DEFAULT)}"""

SUMMARY_OF_COMMENTS = """
per_label AS (
  SELECT video_id, label, count(*) AS n, min(pos) AS first_pos FROM comment_scores GROUP BY video_id, label
),
dominant AS (
  SELECT video_id, first(label ORDER BY n DESC, first_pos) AS dominant_emotion FROM per_label GROUP BY video_id
),
means AS (
  SELECT video_id, avg(confidence) AS avg_emotion_confidence, count(*) AS total_comments
  FROM comment_scores GROUP BY video_id
)"""


def crosstab(rows: str, cols: str) -> str:
    """CTE ``cells(row_label, col_label, n)`` over posts, zeros included."""
    return f"""
pairs AS (SELECT {rows} AS r, {cols} AS c, count(*) AS n FROM posts
          WHERE {rows} IS NOT NULL AND {cols} IS NOT NULL GROUP BY ALL),
cells AS (SELECT a.r AS row_label, b.c AS col_label, coalesce(p.n, 0) AS n
          FROM (SELECT DISTINCT r FROM pairs) a CROSS JOIN (SELECT DISTINCT c FROM pairs) b
          LEFT JOIN pairs p ON p.r = a.r AND p.c = b.c)"""


TERMS = f"""
docs AS (SELECT doc_id, {clean('text')} AS clean FROM documents),
words AS (SELECT doc_id, list_filter(regexp_extract_all(clean, '[{WORD}]{{2,}}'),
            lambda w: NOT list_contains([{listed(STOP_WORDS)}], w)) AS ws FROM docs WHERE clean <> ''),
grams AS (SELECT doc_id, unnest(ws) AS term FROM words
          UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM words),
n_docs AS (SELECT count(*) AS n FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
freq AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term)"""


def tfidf(max_features: int) -> str:
    """CTE ``scores(term, tfidf_score)``."""
    return f"""{TERMS},
vocab AS (SELECT term, df FROM freq, n_docs WHERE df >= 2 AND df <= 0.8 * n
          ORDER BY freq.tf DESC, term LIMIT {max_features}),
weights AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
            FROM tf JOIN vocab USING (term), n_docs),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id),
scores AS (SELECT term, sum(w / norm) / max(n) AS tfidf_score
           FROM weights JOIN norms USING (doc_id), n_docs GROUP BY term)"""
