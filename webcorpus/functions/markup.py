"""Markup expressions: tags, attribute values, script elements and the tag sequence of forms.

Pages are cut by one regular expression that walks the text from left to right, the way an HTML
tokenizer does, so markup inside comments, scripts, styles and quoted values is never taken for tags.
Functions ending in ``_sql`` return Spark SQL text over column names or array-element names.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions import patterns as P
from webcorpus.functions.text_sql import let, quoted

_FIELD, _PAIR = "\x01", "\x02"
# Code points 128-159 in a numeric reference mean the Windows code page.
_CODE_PAGE = {str(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}


def _lookup_sql(table: dict[str, str]) -> str:
    """A constant string map; the optimizer folds it into one literal."""
    text = _PAIR.join(f"{key}{_FIELD}{value}" for key, value in table.items())
    return f"str_to_map({quoted(text)}, {quoted(_PAIR)}, {quoted(_FIELD)})"


def _pieces_sql(html: str, pattern: str) -> str:
    return f"array_remove(regexp_extract_all({html}, {quoted(pattern)}, 1), '')"


def link_tags_sql(html: str) -> str:
    """Array of ``<a>``, ``<link>`` and ``<area>`` tags."""
    return _pieces_sql(html, P.LINK_TAGS)


def script_elements_sql(html: str) -> str:
    """Array of script elements, opening tag and body, in page order; empty without a search if there
    is no script tag."""
    return _pieces_sql(html, P.SCRIPT_ELEMENTS)


def form_parts(html: str) -> Column:
    """Array of form and field tags, and the names of all other tags; NULL for pages without forms."""
    return F.expr(f"IF(rlike({html}, {quoted(P.HAS_FORM)}), {_pieces_sql(html, P.FORM_PARTS)}, NULL)")


def attribute_text_sql(tag: str, name: str) -> str:
    """Text of the last attribute called ``name`` (``href="x"``), NULL if the tag has none."""
    return f"try_element_at({_pieces_sql(tag, P.attribute(name))}, -1)"


def attribute_sql(tag: str, name: str) -> str:
    """Decoded value of attribute ``name``, ``''`` if it has no value, NULL if the tag has none."""
    value = f"regexp_replace({attribute_text_sql(tag, name)}, {quoted(P.ATTRIBUTE_VALUE)}, '$1$2$3')"
    return let(value, "v", decode_references_sql("v"))


def _code_point_sql(digits: str, base: int) -> str:
    value = f"cast(conv(n, {base}, 10) AS int)"
    character = f"""CASE
        WHEN p = 0 OR p BETWEEN 55296 AND 57343 OR p > 1114111 THEN '�'
        WHEN p BETWEEN 128 AND 159 THEN {_lookup_sql(_CODE_PAGE)}[cast(p AS string)]
        ELSE decode(unhex(lpad(hex(p), 8, '0')), 'UTF-32') END"""
    return let(
        f"regexp_replace({digits}, {quoted(P.LEADING_ZEROS)}, '')",
        "n",
        f"IF(length(n) > 7, '�', {let(value, 'p', character)})",
    )


def decode_references_sql(text: str) -> str:
    """Decode ``&name;``, ``&#n;`` and ``&#xn;``; only touches text that holds an ampersand."""
    digits = lambda pattern: f"regexp_extract(r, {quoted(pattern)}, 1)"
    piece = f"""CASE
        WHEN NOT startswith(r, '&') THEN r
        WHEN r = '&amp;' THEN '&'
        WHEN rlike(r, {quoted(P.DECIMAL_REFERENCE)}) THEN {_code_point_sql(digits(P.DECIMAL_REFERENCE), 10)}
        WHEN rlike(r, {quoted(P.HEX_REFERENCE)}) THEN {_code_point_sql(digits(P.HEX_REFERENCE), 16)}
        ELSE coalesce(try_element_at({_lookup_sql(html5)}, substring(r, 2)), r) END"""
    pieces = f"regexp_extract_all({text}, {quoted(P.REFERENCE_PIECES)}, 0)"
    return f"IF(contains({text}, '&'), array_join(transform({pieces}, r -> {piece}), ''), {text})"


def opening_tag_sql(script: str) -> str:
    return f"regexp_extract({script}, {quoted(P.SCRIPT_OPEN_TAG)}, 0)"


def inline_bodies_sql(scripts: str) -> str:
    """Array of the non-empty bodies of the script elements without ``src``, in page order."""
    opened = let(
        opening_tag_sql("e"),
        "o",
        f"IF({attribute_text_sql('o', 'src')} IS NULL, substring(e, length(o) + 1), '')",
    )
    return f"array_remove(transform({scripts}, e -> {opened}), '')"


def escape_html(text: Column) -> Column:
    """``& < > "`` as entities, ampersand first; the apostrophe stays."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
