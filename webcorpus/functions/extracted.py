"""Per-page findings as arrays: one expression per extractor, sets made distinct inside the row.

Because a page is one row, a per-page set costs no shuffle, and several extractors can share one scan.
Arguments are column names; ``base`` is a column made by ``urls.base_parts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions import forms, markup, urls
from webcorpus.functions import patterns as P
from webcorpus.functions.text_sql import let, quoted


def _resolved_sql(tags: str, name: str, base: str) -> str:
    values = f"transform({tags}, tag -> {markup.attribute_sql('tag', name)})"
    return f"transform(array_distinct(array_compact({values})), link -> {urls.resolve_sql('link', base)})"


def tags_with_href(html: str) -> Column:
    """Array of ``struct<tag, href>`` of all link tags that have an ``href``."""
    found = f"""transform({markup.link_tags_sql(html)}, tag -> struct(
        lower(regexp_extract(tag, {quoted(P.TAG_NAME)}, 1)) AS tag, {markup.attribute_sql('tag', 'href')} AS href))"""
    return F.expr(f"filter({found}, found -> found.href IS NOT NULL)")


def link_urls(html: str, base: str) -> Column:
    """Distinct resolved ``href`` of link tags that start with ``http``."""
    resolved = _resolved_sql(markup.link_tags_sql(html), "href", base)
    return F.expr(f"array_distinct(filter({resolved}, url -> startswith(url, 'http')))")


def script_elements(html: str) -> Column:
    return F.expr(markup.script_elements_sql(html))


def script_urls(scripts: str, base: str) -> Column:
    """Distinct resolved non-empty ``src`` of an array of script elements."""
    opening = f"transform({scripts}, e -> {markup.opening_tag_sql('e')})"
    return F.expr(f"array_remove(array_distinct({_resolved_sql(opening, 'src', base)}), '')")


def inline_bodies(scripts: str) -> Column:
    return F.expr(markup.inline_bodies_sql(scripts))


def raw_forms(html: str) -> Column:
    """Array of forms with their fields, action not yet resolved; NULL for pages without a form."""
    return forms.assemble_forms(markup.form_parts(html))


def form_action_sql(action: str, base: str) -> str:
    """Resolved action; the page itself where that cannot be parsed."""
    return let(urls.resolve_sql(action, base), "r", f"IF(r = '', {base}.url, r)")
