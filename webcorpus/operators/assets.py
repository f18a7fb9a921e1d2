"""Joins of captured pages with other captures by URL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.operators.joins import broadcast_if_small
from webcorpus.session import written


def latest(captures: DataFrame, value: str, captured_at: str | None = None) -> DataFrame:
    """``url, value``, one row per URL: that of the last capture, or the greatest value where no time is known."""
    order = F.col(value) if captured_at is None else F.struct(captured_at, value)
    return captures.where(F.col(value).isNotNull()).groupBy("url").agg(F.max_by(value, order).alias(value))


class Scripts(NamedTuple):
    """Captured scripts addressed by content: ``chosen(url, digest)``, one row per referenced URL that was captured with
    status 200, and ``bodies(digest, body)``, one row per distinct chosen body."""

    chosen: DataFrame
    bodies: DataFrame


def script_dictionary(js_urls: DataFrame, js_assets: DataFrame, captured_at: str | None = None) -> Scripts:
    """The capture of each referenced script, chosen by its digest, and a dictionary of bodies by digest.

    The rule is that of ``latest``: the last capture, the greatest body among equal times. It is applied to digests, so bodies
    move only for URLs whose latest captures differ in body. The dictionary fetches each distinct body from one URL that has
    it: a library that a million URLs serve is one row, moved and searched once. The referenced URLs are written once, so the
    pages are searched for them once.
    """
    wanted = written(js_urls.select(F.col("js_url").alias("url")).distinct(), "script-urls")
    time = F.col(captured_at) if captured_at else F.lit(0)
    captured = js_assets.where((F.col("status") == 200) & F.col("body").isNotNull()).join(broadcast_if_small(wanted), "url", "left_semi")
    captured = captured.select("url", "body", time.alias("_t"), F.sha2("body", 256).alias("digest"))
    keyed = captured.select("url", "_t", "digest")
    tops = keyed.groupBy("url").agg(F.max("_t").alias("_t"))
    at_top = written(keyed.join(tops, ["url", "_t"], "left_semi").distinct(), "script-tops")
    counted = at_top.groupBy("url", "_t").agg(F.count("*").alias("_n"), F.min("digest").alias("digest"))
    single = counted.where("_n = 1").select("url", "digest")
    tied = counted.where("_n > 1").select("url", "_t")
    broken = captured.join(broadcast_if_small(written(tied, "script-ties")), ["url", "_t"], "left_semi").groupBy("url").agg(
        F.sha2(F.max("body"), 256).alias("digest")
    )
    chosen = written(single.unionByName(broken), "script-chosen")
    holders = written(chosen.groupBy("digest").agg(F.min("url").alias("url")), "script-holders")
    fetched = captured.join(broadcast_if_small(holders), ["url", "digest"], "left_semi").select("digest", "body")
    # Left are only repeated captures of one URL with one body.
    return Scripts(chosen, fetched.dropDuplicates(["digest"]))


def searched(scripts: Scripts, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of ``source, body`` rows run once per distinct body, its rows then given to every URL with that body."""
    found = search(scripts.bodies.select(F.col("digest").alias("source"), "body"))
    owners = scripts.chosen.select(F.col("digest").alias("source"), F.col("url").alias("_url"))
    return found.join(owners, "source").select(F.col("_url").alias("source"), *[c for c in found.columns if c != "source"])


def js_asset_join(js_urls: DataFrame, js_assets: DataFrame, captured_at: str | None = None) -> DataFrame:
    """``source, body`` of each referenced script that was captured with status 200, one row per URL."""
    scripts = script_dictionary(js_urls, js_assets, captured_at)
    return scripts.chosen.join(scripts.bodies, "digest").select(F.col("url").alias("source"), "body")


def write_by_url(captures: DataFrame, table: str, buckets: int) -> None:
    """Save captures as a table bucketed and sorted by URL; joins of two such tables by URL move nothing."""
    captures.write.bucketBy(buckets, "url").sortBy("url").mode("overwrite").saveAsTable(table)


def write_latest_by_url(captures: DataFrame, table: str, buckets: int, value: str = "html", captured_at: str | None = None) -> None:
    """Save the latest capture of each URL (``url, value``) bucketed and sorted by URL: copies are reduced as they are written,
    so a join with them later is one to one and moves nothing."""
    write_by_url(latest(captures, value, captured_at).select("url", value), table, buckets)


def render_overlay(pages: DataFrame, rendered: DataFrame, captured_at: str | None = None) -> DataFrame:
    """Pages with their html replaced where a rendered copy of the URL exists; the last one if there are several.

    Both sides carry html: for large tables write the pages with ``write_by_url`` and the copies with ``write_latest_by_url``
    into the same number of buckets, and join them with ``overlay_written``.
    """
    return _overlaid(pages, latest(rendered, "html", captured_at))


def overlay_written(pages: DataFrame, copies: DataFrame) -> DataFrame:
    """The overlay of two tables bucketed by URL into equal numbers of buckets, ``copies`` with one row per URL: a join within
    each bucket, without an exchange; html of pages without a copy stays where it was read."""
    return _overlaid(pages, copies)


def _overlaid(pages: DataFrame, copies: DataFrame) -> DataFrame:
    copies = copies.select("url", F.col("html").alias("_rendered"))
    return pages.join(copies, "url", "left").select(
        *[
            F.coalesce("_rendered", "html").alias("html") if name == "html" else F.col(name)
            for name in pages.columns
        ]
    )
