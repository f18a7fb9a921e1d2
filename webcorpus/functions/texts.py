"""Expressions over raw text: e-mail addresses, comments, endpoints in scripts, masked secrets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions import patterns as P
from webcorpus.functions.text_sql import let, quoted
from webcorpus.functions.urls import strip_space_sql


_NO_TEXTS = "cast(array() AS array<string>)"


def holds_one_of_sql(text: str, literals: Iterable[str], any_case: bool = False) -> str:
    """Cheap test that lets a search be skipped; lower-cases the text once."""
    marks = lambda t: " OR ".join(f"contains({t}, {quoted(mark)})" for mark in literals)
    return let(f"lower({text})", "low", marks("low")) if any_case else f"({marks(text)})"


def emails(text: str) -> Column:
    """Distinct e-mail addresses of a text; the search only runs where there is an ``@``."""
    found = f"array_distinct(regexp_extract_all({text}, {quoted(P.EMAIL_LINEAR)}, 0))"
    return F.expr(f"IF(contains({text}, '@'), {found}, {_NO_TEXTS})")


def telling_comments(html: str) -> Column:
    """Comment bodies in page order: stripped, longer than five characters, cut to 300."""
    bodies = f"regexp_extract_all({html}, {quoted(P.COMMENT_LINEAR)}, 1)"
    stripped = f"transform({bodies}, c -> {strip_space_sql('c')})"
    return F.expr(
        f"transform(filter({stripped}, c -> length(c) > {P.COMMENT_MIN_LENGTH}), "
        f"c -> substring(c, 1, {P.COMMENT_CUT}))"
    )


def endpoints_of_sql(script: str, category: str) -> str:
    """Distinct endpoint references of one category in a script."""
    pattern, group, needed = P.ENDPOINTS_LINEAR[category]
    found = f"array_distinct(regexp_extract_all({script}, {quoted(pattern)}, {group}))"
    if not needed:
        return found
    present = holds_one_of_sql(script, needed, any_case=category in P.ENDPOINT_IGNORE_CASE)
    return f"IF({present}, {found}, {_NO_TEXTS})"


def endpoints_sql(script: str, categories: Iterable[str] = tuple(P.ENDPOINT_PATTERNS)) -> str:
    """Array of ``struct<category, value>`` over several categories."""
    return "concat({})".format(
        ", ".join(
            f"transform({endpoints_of_sql(script, c)}, v -> struct({quoted(c)} AS category, v AS value))"
            for c in categories
        )
    )


def is_idor_name(name: Column) -> Column:
    return name.rlike(rf"(?iu)\A(?:{P.IDOR_NAMES})\n?\z")


def is_admin_name(name: Column) -> Column:
    return name.rlike(f"(?iu)(?:{P.ADMIN_NAMES})")


@dataclass(frozen=True)
class Detector:
    """One kind of secret: where it is (group 1), and how random it has to look."""

    kind: str
    pattern: str
    needed: tuple[str, ...]  # literals of which one must be in the text, else the search is skipped
    min_entropy: float
    confidence: str
    any_case: bool = False  # the literals are looked for in the lower-cased text


# Own rules: quoted assignments to a telling name, key formats with a published prefix, PEM headers.
DETECTORS = (
    Detector(
        "assignment",
        r"""(?i)(?=[apst])(?:api_?key|secret|token|passw(?:or)?d|access_?key)["']?\s*[:=]\s*["']([^\s"']{8,})["']""",
        ("key", "secret", "token", "passw"),
        3.0,
        "medium",
        any_case=True,
    ),
    Detector("aws_access_key", r"\b(AKIA[0-9A-Z]{16})\b", ("AKIA",), 0.0, "high"),
    Detector("google_api_key", r"\b(AIza[0-9A-Za-z_\-]{35})", ("AIza",), 0.0, "high"),
    Detector("github_token", r"\b(gh[pousr]_[0-9A-Za-z]{36})\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 0.0, "high"),
    Detector("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", ("PRIVATE KEY",), 0.0, "high"),
)


def entropy_sql(text: str) -> str:
    """Shannon entropy in bits per character."""
    share = f"(length({text}) - length(replace({text}, ch, ''))) / length({text})"
    shares = f"transform(array_distinct(split({text}, '')), ch -> {share})"
    return f"aggregate({shares}, 0D, (total, p) -> total - p * log2(p))"


def preview_sql(secret: str) -> str:
    """First and last four characters; a short value is masked whole."""
    return f"""IF(length({secret}) > 8,
        concat(left({secret}, 4), '…', right({secret}, 4)), repeat('*', length({secret})))"""


def secrets_sql(text: str, detectors: Iterable[Detector] = DETECTORS) -> str:
    """Array of ``struct<type, confidence, value_preview, entropy>``; the value itself never leaves."""
    found = []
    for detector in detectors:
        values = f"regexp_extract_all({text}, {quoted(detector.pattern)}, 1)"
        rated = f"transform({values}, s -> struct(s AS s, {entropy_sql('s')} AS entropy))"
        hit = f"""struct({quoted(detector.kind)} AS type, {quoted(detector.confidence)} AS confidence,
            {preview_sql('h.s')} AS value_preview, round(h.entropy, 6) AS entropy)"""
        hits = f"transform(filter({rated}, h -> h.entropy >= {detector.min_entropy}D), h -> {hit})"
        present = holds_one_of_sql(text, detector.needed, detector.any_case)
        found.append(f"IF({present}, {hits}, NULL)")
    return f"flatten(array_compact(array({', '.join(found)})))"
