"""Which fields belong to which form.

A form ends at its own closing tag or where an element around it is closed, so membership depends on the
stack of open elements. That is sequential per page and has no built-in; a small Pandas UDF walks the tag
names that the JVM has already cut out of the pages holding a form. Text, scripts and other attributes
never reach Python.
"""

from __future__ import annotations

import re
import sys
from html import entities, unescape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.functions import patterns as P
from webcorpus.functions.text_sql import quoted

# Ship this module's functions with the query, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIELD_TYPE = T.StructType().add("name", T.StringType()).add("type", T.StringType())
FORM_TYPE = (
    T.StructType()
    .add("action", T.StringType())
    .add("method", T.StringType())
    .add("inputs", T.ArrayType(_FIELD_TYPE))
)
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
_ATTRIBUTE = re.compile(
    r"""([^\s/>=]+)(?:\s*=+\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?"""
)
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?![a-zA-Z0-9=])))")


def _decode(match: re.Match) -> str:
    text = match.group()
    return unescape(text) if text[1] == "#" else entities.html5.get(text[1:], text)


def _attributes(tag: str, size: int) -> dict[str, str]:
    return {
        m.group(1).lower(): _REFERENCE.sub(_decode, m.group(2) or m.group(3) or m.group(4) or "")
        for m in _ATTRIBUTE.finditer(tag, size)
    }


def forms_of(parts) -> list[dict]:
    """Forms of one page from its tag sequence, fields in page order."""
    forms, open_tags, open_forms, counts = [], [], [], {}
    for part in parts:
        closing = part.startswith("/")
        name = re.match(r"/?([^\s/>]*)", part).group(1).lower()
        if closing:
            while counts.get(name):
                top = open_tags.pop()
                counts[top] -= 1
                if top == "form":
                    open_forms.pop()
                if top == name:
                    break
            continue
        form = None
        if name == "form":
            attributes = _attributes(part, 4)
            form = {
                "action": attributes.get("action", ""),
                "method": attributes.get("method", "GET").upper(),
                "inputs": [],
            }
            forms.append(form)
        elif name in ("input", "textarea", "select") and counts.get("form"):
            attributes = _attributes(part, len(name))
            kind = name
            if kind == "input":
                kind = attributes.get("type", "text")
            field = {"name": attributes.get("name", ""), "type": kind}
            for around in open_forms:
                around["inputs"].append(field)
        if name not in _VOID and name != "textarea" and not part.endswith("/"):
            open_tags.append(name)
            if form is not None:
                open_forms.append(form)
            counts[name] = counts.get(name, 0) + 1
    return forms


@F.pandas_udf(T.ArrayType(FORM_TYPE))
def assemble_forms(parts: pd.Series) -> pd.Series:
    return parts.map(lambda page: None if page is None else forms_of(page))


def has_csrf_field_sql(inputs: str) -> str:
    return f"exists({inputs}, field -> rlike(field.name, {quoted(P.CSRF_FIELD)}))"


def form_issues_sql(method: str, inputs: str, csrf_protected: str) -> str:
    """Issue texts of one form in fixed order; an empty array for a form without any."""
    password = f"exists({inputs}, field -> contains(lower(field.name), 'pass'))"
    file_field = f"exists({inputs}, field -> field.type = 'file')"
    return f"""array_compact(array(
        IF({method} = 'GET' AND {password}, {quoted(P.ISSUE_PASSWORD_GET)}, NULL),
        IF({method} = 'POST' AND NOT {csrf_protected}, {quoted(P.ISSUE_NO_CSRF)}, NULL),
        IF({file_field}, {quoted(P.ISSUE_FILE)}, NULL)))"""
