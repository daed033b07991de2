"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

All queries run once to warm the JVM up, then in three more rounds; the median
counts. Results are computed in full and discarded (``noop`` sink); nothing is kept
from one run to the next.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from postlens.plans import queries as Q
from postlens.session import build_session, discard_work, work_scope

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = 3
HEADLINE = (
    "full_analysis", "comment_emotions", "dominant_emotion", "tfidf_terms", "document_frequency",
    "clean_text", "crosstab_with_margins", "engagement_by_sentiment", "high_engagement_sentiment",
    "page_metrics", "new_posts_only", "stream_ingest", "read_posts", "export_rows", "lda_topics",
    "score_sentiment_table", "page_default_rules", "confidence_p75",
)


def run(spark, name: str) -> float:
    started = time.perf_counter()
    with work_scope(spark):
        Q.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started


def main() -> None:
    spark = build_session("postlens-bench", f"local[{CPUS}]", int(CPUS) if CPUS.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    rounds = [{name: run(spark, name) for name in HEADLINE} for _ in range(1 + ROUNDS)]
    seconds = {
        name: round(statistics.median(r[name] for r in rounds[1:]), 3) for name in HEADLINE
    }
    discard_work(spark)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", FOLDER)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }), flush=True)


if __name__ == "__main__":
    main()
