"""Extractors: captured pages in, one finding per row out.

All take a frame with ``url`` and ``html`` and are local to a page, so they need no shuffle. Per-page sets
are made distinct inside the row; corpus-wide sets are one ``distinct`` on top (see ``distinct_values``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import extracted, patterns, texts, urls
from webcorpus.functions import forms as form_functions


def nonempty_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.length("html") > 0)


def internal_urls(pages: DataFrame) -> DataFrame:
    """Every captured URL once, pages without text included."""
    return pages.select("url").distinct()


def _with_base(pages: DataFrame) -> DataFrame:
    return nonempty_pages(pages).withColumn("base", urls.base_parts("url"))


def _with_scripts(pages: DataFrame) -> DataFrame:
    return _with_base(pages).withColumn("scripts", extracted.script_elements("html"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """``page_url, pos, tag, href, url`` for every link tag with an ``href``, duplicates kept."""
    found = _with_base(pages).select(
        F.col("url").alias("page_url"),
        "base",
        F.posexplode(extracted.tags_with_href("html")).alias("pos", "link"),
    )
    return found.select(
        "page_url", "pos", "link.tag", "link.href", urls.resolve("link.href", "base").alias("url")
    )


def page_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The set of absolute links of each page: edges ``page_url -> url`` of the link graph.

    ``keep`` names further page columns to carry along.
    """
    return _with_base(pages).select(
        F.col("url").alias("page_url"), *keep, F.explode(extracted.link_urls("html", "base")).alias("url")
    )


def js_files(pages: DataFrame) -> DataFrame:
    """The set of script URLs of each page; any scheme passes."""
    return _with_scripts(pages).select(
        F.col("url").alias("page_url"),
        F.explode(extracted.script_urls("scripts", "base")).alias("js_url"),
    )


def inline_scripts(pages: DataFrame) -> DataFrame:
    """``page_url, pos, body`` of scripts without ``src``, empty ones left out."""
    return _with_scripts(pages).select(
        F.col("url").alias("page_url"),
        F.posexplode(extracted.inline_bodies("scripts")).alias("pos", "body"),
    )


def emails(pages: DataFrame, text: str = "html", source: str = "url") -> DataFrame:
    """Distinct e-mail addresses per source text, from the raw text."""
    return pages.select(
        F.col(source).alias("source"), F.explode(texts.emails(text)).alias("email")
    )


def html_comments(pages: DataFrame) -> DataFrame:
    """``source, pos, comment``: comments longer than five characters, cut to 300, a bag."""
    return nonempty_pages(pages).select(
        F.col("url").alias("source"),
        F.posexplode(texts.telling_comments("html")).alias("pos", "comment"),
    )


def forms(pages: DataFrame) -> DataFrame:
    """``found_on, form_pos, action, method, inputs, csrf_protected``: one row per form, a bag."""
    found = _with_base(pages).select(
        F.col("url").alias("found_on"),
        "base",
        F.posexplode(extracted.raw_forms("html")).alias("form_pos", "form"),
    )
    return found.select(
        "found_on",
        "form_pos",
        F.expr(extracted.form_action_sql("form.action", "base")).alias("action"),
        F.col("form.method").alias("method"),
        F.col("form.inputs").alias("inputs"),
        F.expr(form_functions.has_csrf_field_sql("form.inputs")).alias("csrf_protected"),
    )


def form_fields(found_forms: DataFrame) -> DataFrame:
    """``found_on, form_pos, field_pos, name, type``: the fields of the forms, flat."""
    return found_forms.select(
        "found_on", "form_pos", F.posexplode("inputs").alias("field_pos", "field")
    ).select("found_on", "form_pos", "field_pos", "field.name", "field.type")


def url_params(pages: DataFrame) -> DataFrame:
    """Distinct parameter names in the URL of each page that has text."""
    return nonempty_pages(pages).select(
        F.col("url").alias("source"), F.explode(urls.param_names(F.col("url"))).alias("name")
    )


def form_params(found_forms: DataFrame) -> DataFrame:
    """Non-empty field names, a set within each form."""
    names = F.array_distinct(F.array_remove(F.col("inputs.name"), ""))
    return found_forms.select(F.col("found_on").alias("source"), F.explode(names).alias("name"))


def endpoints(scripts: DataFrame, categories=tuple(patterns.ENDPOINT_PATTERNS)) -> DataFrame:
    """``source, category, value`` from ``source, body`` rows; a set within each body."""
    return scripts.select("source", F.inline(F.expr(texts.endpoints_sql("body", categories))))


def secrets(sources: DataFrame, detectors=texts.DETECTORS) -> DataFrame:
    """``source, type, confidence, value_preview, entropy`` from ``source, body`` rows, a bag."""
    return sources.select("source", F.inline(F.expr(texts.secrets_sql("body", detectors))))


def distinct_values(findings: DataFrame, value: str) -> DataFrame:
    """Corpus-wide set of one column: partial and final hash aggregate, so hot values shrink early."""
    return findings.select(value).distinct()
