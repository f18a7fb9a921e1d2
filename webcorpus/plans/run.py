"""The whole run over captured pages as one plan: scope, crawl, rendered copies, content gate, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.operators import assets, crawl, exposure
from webcorpus.operators.joins import broadcast_if_small
from webcorpus.plans.findings import corpus_findings
from webcorpus.session import written
from webcorpus.sources.captures import content_gate


def reached_pages(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """Captures of the URLs that a crawl visited; a fragment of a page's URL doesn't tell it apart."""
    urls = visited.select(F.col("url").alias("_url")).distinct()
    own = F.regexp_extract("url", "^[^#]*", 0)
    return pages.join(broadcast_if_small(urls), own == F.col("_url"), "left_semi")


def full_run(
    pages: DataFrame,
    allowed: DataFrame,
    start: DataFrame,
    max_depth: int,
    max_pages: int,
    robots_files: DataFrame | None = None,
    known_links: DataFrame | None = None,
    rendered: DataFrame | None = None,
    js_assets: DataFrame | None = None,
    responses: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Findings of the pages that a scoped, capped crawl from ``start`` reaches.

    ``known_links`` (``page_url, url``) are links from elsewhere, such as site maps; they pass the same filters as those of
    the pages. Well-known paths are looked up for the hosts of the pages reached.
    """
    edges = crawl.crawl_edges(pages, allowed, robots_files, known_links=known_links)
    visited = written(crawl.crawl_capped(edges, start, max_depth, max_pages), "visited")
    reached = reached_pages(pages, visited)
    if rendered is not None:
        reached = assets.render_overlay(reached, rendered)
    exposed = None if responses is None else exposure.exposed_files(responses, reached.select("url"))
    return corpus_findings(content_gate(reached), js_assets=js_assets, exposed=exposed, errors=errors)
