"""DuckDB counterparts of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from webcorpus.llm.quality_rules import LEAST_WORDS, RULES

_SPACE = "[\\x20\\x09-\\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Sets of 5-word shingles, links by counted overlaps, and components by walking the links.
NGRAM_JOIN = f"""WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_SPACE}'), lambda w: w <> '') AS w FROM documents),
members AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0) AS places),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM members AS a JOIN members AS b USING (gram)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM shared JOIN sizes AS a ON a.doc_id = x JOIN sizes AS b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
walk(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, low FROM walk JOIN links ON x = walk.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(low) AS component_id
FROM documents AS d LEFT JOIN sizes USING (doc_id) JOIN walk USING (doc_id) GROUP BY d.doc_id"""

WARC = """WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
firsts AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM payloads)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to, true AS whole
FROM firsts"""


def _figure(rule: str) -> str:
    above, below = RULES[rule][0].split(" / ")
    return f"(CAST({above} AS DOUBLE) / nullif({below}, 0))"


def _tail(k: str, rate: float) -> str:
    """P(Bin(n, rate) <= k)."""
    term = f"exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({rate}) + (n - j) * ln(1 - {rate}))"
    return f"CASE WHEN {k} > n * {rate} THEN 1.0 ELSE list_sum(list_transform(range(0, {k} + 1), lambda j: {term})) END"


def quality_rules(risk: float = 0.02, error: float = 0.05) -> str:
    rate = risk / len(RULES)
    counts, cuts = [], []
    for rule, (_, grid) in RULES.items():
        certified, safe = "true", []
        for i, cut in reversed(list(enumerate(grid))):
            counts.append(f"count(*) FILTER (WHERE {_figure(rule)} > {cut}) AS {rule}_{i}")
            certified += f" AND {_tail(f'{rule}_{i}', rate)} <= {error / len(RULES)} / strata"
            safe.append(f"CASE WHEN {certified} THEN {cut} END")
        cuts.append(f"least({', '.join(safe)}) AS cut_{rule}")
    rejected = " OR ".join(f"coalesce({_figure(rule)} > cut_{rule}, false)" for rule in RULES)
    return f"""WITH split AS (
    SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS three
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 3) AS places),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows) AS c WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) AS p GROUP BY doc_id),
figures AS (
    SELECT s.doc_id, s.lang AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals, len(lines) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM split AS s LEFT JOIN covered AS c USING (doc_id)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures),
counted AS (SELECT *, count(*) OVER () AS strata FROM (SELECT stratum, count(*) AS n, {', '.join(counts)} FROM judged
    WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1)
    GROUP BY stratum) AS g),
cutoffs AS (SELECT stratum, {', '.join(cuts)} FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept
FROM judged LEFT JOIN cutoffs ON cutoffs.stratum IS NOT DISTINCT FROM judged.stratum"""


ORACLES = {
    "op5_ngram_join": NGRAM_JOIN,
    "op7_quality_rules": quality_rules(),
    "op8_warc": WARC,
}
