"""Captured responses at well-known paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import patterns, urls
from webcorpus.operators.joins import broadcast_if_small
from webcorpus.session import written
from webcorpus.sources.captures import header


def exposed_files(responses: DataFrame, targets: DataFrame) -> DataFrame:
    """``url, status, content_length`` of well-known root paths of the targets that answered exactly 200.

    The 19 paths are literals in a filter. Only the bases of the targets are joined.
    """
    hits = responses.filter(F.col("status") == 200).withColumn("_base", urls.base_of(F.col("url")))
    rest = F.substr(F.col("url"), F.length("_base") + F.lit(1))
    hits = hits.filter(rest.isin(*["/" + path for path in patterns.WELL_KNOWN_PATHS])).filter(
        F.startswith("url", F.col("_base"))
    )
    # Stored, since it is measured and then joined.
    bases = written(targets.select(urls.base_of(F.col("url")).alias("_base")).distinct(), "bases")
    return hits.join(broadcast_if_small(bases), "_base", "left_semi").select(
        "url",
        "status",
        F.coalesce(header(F.col("headers"), "content-length"), F.lit("?")).alias("content_length"),
    )
