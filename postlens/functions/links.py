"""Post links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.schema import POST_ID_PATTERN


def post_id(url: Column, pattern: str = POST_ID_PATTERN) -> Column:
    """Id captured by group 1 of the pattern, null if the link has none."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def absolute_url(link: Column, host: str) -> Column:
    """Full link: ``/x`` and ``x`` are put below ``host``, ``http…`` stays."""
    host = host.rstrip("/")
    return (
        F.when(link.startswith("/"), F.concat(F.lit(host), link))
        .when(~link.startswith("http"), F.concat(F.lit(host + "/"), link))
        .otherwise(link)
    )
