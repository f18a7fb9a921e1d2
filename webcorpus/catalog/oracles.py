"""DuckDB counterparts of the registered queries.

Written apart from the Spark expressions: RE2 patterns, joins and window functions over the same inputs. They
only have to be right for the given pages and the markup added to them, not for markup in general.
"""

from __future__ import annotations

from webcorpus.catalog.fixtures import SCOPE, TABLES, duckdb_ctes
from webcorpus.functions import patterns as P


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EMPTY = "CAST(NULL AS VARCHAR)"
_ORIGIN = "regexp_extract(page_url, '^https?://[^/?#]*')"
_SCHEME = "regexp_extract(page_url, '^https?:')"


def _resolved(link: str) -> str:
    """Resolution of the link shapes that occur: empty, rooted, host-relative, absolute."""
    joined = f"""CASE WHEN {link} = '' THEN page_url WHEN {link} LIKE '//%' THEN {_SCHEME} || {link}
        WHEN {link} LIKE '/%' THEN {_ORIGIN} || {link} ELSE {link} END"""
    return f"regexp_replace({joined}, '#.*$', '')"


def _attribute(tag: str, name: str) -> str:
    return (
        f"""replace(regexp_extract({tag}, '\\s{name}\\s*=\\s*"([^"]*)"', 1, 'i'), '&amp;', '&')"""
    )


_SKIP = r"!--.*?-->|style\b[^>]*>.*?</style\s*>|title\b[^>]*>.*?</title\s*>"
_TAG = r"""[a-z!?/](?:[^>"']|"[^"]*"|'[^']*')*>"""
_SCRIPT = r"script\b[^>]*>.*?(?:</script\s*>|\z)"


def _lexed(pages: str, wanted: str, skipped: str) -> str:
    """``page_id, page_url, i, piece`` of group 1 of a left-to-right pass over html."""
    pattern = rf"<(?:{_SKIP}|{skipped}{wanted}|{_TAG})"
    return f"""SELECT page_id, page_url, i, piece FROM (
        SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {_q(pattern)}, 1, 'is')) AS piece,
            generate_subscripts(regexp_extract_all(html, {_q(pattern)}, 1, 'is'), 1) AS i
        FROM {pages}) WHERE piece <> ''"""


def _links(pages: str) -> str:
    tag = r"""((?:a|link|area)\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""
    return f"""SELECT page_id, page_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos,
        lower(regexp_extract(piece, '^[a-zA-Z]+')) AS tag, {_attribute('piece', 'href')} AS href
        FROM ({_lexed(pages, tag, _SCRIPT + '|')}) WHERE regexp_matches(piece, '\\shref\\s*=', 'i')"""


def _page_links(pages: str) -> str:
    return f"""SELECT page_url, url FROM (SELECT DISTINCT page_id, page_url, {_resolved('href')} AS url
        FROM ({_links(pages)})) WHERE url LIKE 'http%'"""


def _scripts(pages: str) -> str:
    script = r"(script\b[^>]*>.*?)(?:</script\s*>|\z)"
    return f"""SELECT page_id, page_url, i, regexp_extract(piece, '^script\\b[^>]*>', 0, 'i') AS opening,
        regexp_replace(piece, '^script\\b[^>]*>', '', 'i') AS body FROM ({_lexed(pages, script, '')})"""


def _inline(pages: str) -> str:
    return f"""SELECT page_id, page_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos,
        body FROM ({_scripts(pages)}) WHERE NOT regexp_matches(opening, '\\ssrc\\b', 'i') AND body <> ''"""


def _js(pages: str) -> str:
    return f"""SELECT page_id, page_url, js_url, min(i) AS i FROM (
        SELECT page_id, page_url, i, {_resolved(_attribute('opening', 'src'))} AS js_url FROM ({_scripts(pages)})
        WHERE regexp_matches(opening, '\\ssrc\\b', 'i')) GROUP BY page_id, page_url, js_url"""


def _comments(pages: str) -> str:
    pattern = _q(P.COMMENT)
    return f"""SELECT page_id, source, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos,
        substr(c, 1, 300) AS comment FROM (SELECT page_id, source, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS c
        FROM (SELECT page_id, url AS source, unnest(regexp_extract_all(html, {pattern}, 1, 's')) AS raw,
            generate_subscripts(regexp_extract_all(html, {pattern}, 1, 's'), 1) AS i FROM {pages}))
        WHERE length(c) > 5"""


def _emails(table: str, text: str, source: str) -> str:
    return f"""SELECT DISTINCT {source}, unnest(regexp_extract_all({text}, {_q(P.EMAIL)})) AS email FROM {table}"""


def _url_params(pages: str) -> str:
    query = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
    return f"""SELECT DISTINCT page_id, source, name FROM (
        SELECT page_id, url AS source, unnest(regexp_extract_all(url, {_q(P.URL_PARAM)}, 1)) AS name FROM {pages}
        UNION ALL
        SELECT page_id, source, url_decode(replace(split_part(pair, '=', 1), '+', ' ')) FROM (
            SELECT page_id, url AS source, unnest(string_split({query}, '&')) AS pair FROM {pages})
        WHERE regexp_matches(pair, '^[^=]*=.'))"""


def _forms(pages: str) -> str:
    block = _q(r"<form\b[^>]*>.*?(?:</form\s*>|\z)")
    method = f"upper({_attribute('opening', 'method')})"
    action = _resolved(_attribute("opening", "action"))
    return f"""SELECT page_id, page_url AS found_on, pos AS form_pos, {action} AS action,
        CASE WHEN regexp_matches(opening, '\\smethod\\b', 'i') THEN {method} ELSE 'GET' END AS method, block
        FROM (SELECT page_id, page_url, CAST(i - 1 AS INTEGER) AS pos, block,
            regexp_extract(block, '^<form\\b[^>]*>', 0, 'i') AS opening
        FROM (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {block}, 0, 'is')) AS block,
            generate_subscripts(regexp_extract_all(html, {block}, 0, 'is'), 1) AS i FROM {pages}))"""


def _fields(forms: str) -> str:
    field = _q(r"<(?:input|textarea|select)\b[^>]*>")
    kind = "lower(regexp_extract(tag, '^<([a-z]+)', 1, 'i'))"
    return f"""SELECT page_id, found_on, form_pos, CAST(i - 1 AS INTEGER) AS field_pos, {_attribute('tag', 'name')} AS name,
        CASE WHEN {kind} <> 'input' THEN {kind} WHEN regexp_matches(tag, '\\stype\\b', 'i')
            THEN {_attribute('tag', 'type')} ELSE 'text' END AS type
        FROM (SELECT page_id, found_on, form_pos, unnest(regexp_extract_all(block, {field}, 0, 'is')) AS tag,
            generate_subscripts(regexp_extract_all(block, {field}, 0, 'is'), 1) AS i FROM {forms})"""


_FORM_FACTS = f"""SELECT f.page_id, f.found_on, f.form_pos, f.action, f.method,
    CAST(count(g.name) AS INTEGER) AS n_inputs,
    coalesce(bool_or(regexp_matches(g.name, '{P.CSRF_NAMES}', 'i')), false) AS csrf_protected,
    coalesce(bool_or(contains(lower(g.name), 'pass')), false) AS has_password,
    coalesce(bool_or(g.type = 'file'), false) AS has_file
    FROM forms AS f LEFT JOIN fields AS g USING (page_id, form_pos) GROUP BY ALL"""

_ISSUES = f"""SELECT page_id, action, found_on, form_pos, method, n, issue FROM form_facts, LATERAL (
    SELECT 1 AS n, {_q(P.ISSUE_PASSWORD_GET)} AS issue WHERE method = 'GET' AND has_password
    UNION ALL SELECT 2, {_q(P.ISSUE_NO_CSRF)} WHERE method = 'POST' AND NOT csrf_protected
    UNION ALL SELECT 3, {_q(P.ISSUE_FILE)} WHERE has_file)"""

_DETECTORS = (
    (
        "assignment",
        r"""(?:api_?key|secret|token|passw(?:or)?d|access_?key)["']?\s*[:=]\s*["']([^\s"']{8,})["']""",
        "i",
        3.0,
        "medium",
    ),
    ("aws_access_key", r"\b(AKIA[0-9A-Z]{16})\b", "c", 0.0, "high"),
    ("google_api_key", r"\b(AIza[0-9A-Za-z_\-]{35})", "c", 0.0, "high"),
    ("github_token", r"\b(gh[pousr]_[0-9A-Za-z]{36})\b", "c", 0.0, "high"),
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "c", 0.0, "high"),
)


def _secrets(texts: str) -> str:
    """Masked secrets of ``page_id, source, body`` rows."""
    found = " UNION ALL ".join(
        f"""SELECT page_id, source, '{kind}' AS type, '{confidence}' AS confidence, {floor} AS floor,
        unnest(regexp_extract_all(body, {_q(pattern)}, 1, '{flags}')) AS v FROM {texts}"""
        for kind, pattern, flags, floor, confidence in _DETECTORS
    )
    return f"""SELECT page_id, source, type, confidence, CASE WHEN length(v) > 8 THEN left(v, 4) || '…' || right(v, 4)
        ELSE repeat('*', length(v)) END AS value_preview, round(entropy, 6) AS entropy
        FROM (SELECT *, list_entropy(string_split(v, '')) AS entropy FROM ({found})) WHERE entropy >= floor"""


def _endpoints(scripts: str) -> str:
    parts = []
    for category, pattern in P.ENDPOINT_PATTERNS.items():
        group = 1 if pattern.startswith("[\"'](") else 0
        flags = "i" if category in P.ENDPOINT_IGNORE_CASE else "c"
        parts.append(
            f"""SELECT page_id, source, '{category}' AS category,
            unnest(regexp_extract_all(body, {_q(pattern)}, {group}, '{flags}')) AS value FROM {scripts}"""
        )
    return " UNION ".join(parts)


def _gated(table: str) -> str:
    kept = " OR ".join(f"contains(content_type, '{mark}')" for mark in ("text", "javascript", "json"))
    return f"""SELECT page_id, url, status,
        CASE WHEN {kept} OR content_type = '' THEN html ELSE '' END AS html FROM {table}"""


_TITLES = {
    "internal_urls": "Internal URLs",
    "js_files": "JavaScript Files",
    "params": "Parameters",
    "emails": "Emails",
}
_CATEGORY_TITLES = {
    "full_urls": "Full Urls",
    "api_paths": "Api Paths",
    "graphql_endpoints": "Graphql Endpoints",
    "websocket_endpoints": "Websocket Endpoints",
    "s3_buckets": "S3 Buckets",
    "firebase_urls": "Firebase Urls",
    "swagger_docs": "Swagger Docs",
}
_IDOR = f"regexp_matches(name, '^(?:{P.IDOR_NAMES})$', 'i')"
_ADMIN = f"regexp_matches(name, '{P.ADMIN_NAMES}', 'i')"

# Parts of an oracle, each reading the ones above it; "page" is the table the extractors run on.
_PARTS = {
    "links": _links("page"),
    "page_links": _page_links("page"),
    "inline": _inline("page"),
    "js": _js("page"),
    "asset_texts": """SELECT a.url AS source, a.body FROM js_assets AS a
        WHERE a.status = 200 AND a.url IN (SELECT js_url FROM js)""",
    "script_texts": """SELECT page_id, page_url AS source, body FROM inline
        UNION ALL SELECT NULL, source, body FROM asset_texts""",
    "all_texts": """SELECT page_id, 0 AS kind, url AS source, html AS body FROM page WHERE html <> ''
        UNION ALL SELECT page_id, 1, page_url || ' (inline script)', body FROM inline
        UNION ALL SELECT NULL, 2, source, body FROM asset_texts""",
    "secrets": _secrets("all_texts"),
    "endpoints": _endpoints("script_texts"),
    "page_scripts": "SELECT page_id, page_url AS source, body FROM inline",
    "page_endpoints": _endpoints("page_scripts"),
    "forms": _forms("page"),
    "fields": _fields("forms"),
    "form_facts": _FORM_FACTS,
    "issues": _ISSUES,
    "comments": _comments("page"),
    "emails": _emails("page", "html", "page_id, url AS source"),
    "url_params": _url_params("full_pages"),
    "form_names": """SELECT DISTINCT page_id, found_on AS source, form_pos, name FROM fields WHERE name <> ''""",
    "names": """SELECT page_id, name FROM url_params UNION ALL
        SELECT page_id, name FROM (SELECT DISTINCT page_id, name FROM form_names)""",
    "exposed": f"""SELECT url, status, coalesce(content_length, '?') AS content_length FROM responses
        WHERE status = 200 AND regexp_extract(url, '^(https?://[^/?#]*)', 1) IN
            (SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) FROM pages)
        AND regexp_extract(url, '^https?://[^/?#]*/(.*)$', 1) IN ({', '.join(_q(p) for p in P.WELL_KNOWN_PATHS)})""",
    "last_errors": """SELECT url, arg_max(error, (ts, error)) AS error FROM fetch_log WHERE error IS NOT NULL GROUP BY url""",
    "once": """SELECT 'internal_urls' AS section, '' AS category, url AS value, count(*) AS n FROM page GROUP BY url
        UNION ALL SELECT 'js_files', '', js_url, count(*) FROM js GROUP BY js_url
        UNION ALL SELECT 'js_endpoint_findings', category, value, count(*) FROM (
            SELECT DISTINCT page_id, source, category, value FROM endpoints) GROUP BY category, value
        UNION ALL SELECT 'emails', '', email, count(*) FROM emails GROUP BY email
        UNION ALL SELECT 'params', '', name, count(*) FROM names GROUP BY name""",
    "totals": f"""SELECT CASE WHEN category = '' THEN section ELSE section || '.' || category END AS section,
            count(*) AS n FROM once GROUP BY section, category
        UNION ALL SELECT 'idor_candidates', count(*) FROM (SELECT DISTINCT name FROM names) WHERE {_IDOR}
        UNION ALL SELECT 'admin_param_candidates', count(*) FROM (SELECT DISTINCT name FROM names) WHERE {_ADMIN}
        UNION ALL SELECT 'forms', count(*) FROM forms HAVING count(*) > 0
        UNION ALL SELECT 'form_risk_flags', count(*) FROM (SELECT DISTINCT page_id, form_pos FROM issues) HAVING count(*) > 0
        UNION ALL SELECT 'secrets', count(*) FROM secrets HAVING count(*) > 0
        UNION ALL SELECT 'comments', count(*) FROM comments HAVING count(*) > 0
        UNION ALL SELECT 'interesting_files', count(*) FROM exposed HAVING count(*) > 0
        UNION ALL SELECT 'errors', count(*) FROM last_errors HAVING count(*) > 0""",
    "flags": """SELECT page_id, action, found_on, form_pos, method, string_agg(issue, ', ' ORDER BY n) AS issues
        FROM issues GROUP BY ALL""",
    "items": f"""SELECT CASE section {' '.join(f"WHEN '{s}' THEN '{t}'" for s, t in _TITLES.items())}
            ELSE CASE category {' '.join(f"WHEN '{s}' THEN '{t}'" for s, t in _CATEGORY_TITLES.items())} END END AS section,
            value AS item, value AS k1, NULL AS k2, 0 AS k3 FROM once
        UNION ALL SELECT 'IDOR-Candidate Params', name, name, NULL, 0 FROM (SELECT DISTINCT name FROM names) WHERE {_IDOR}
        UNION ALL SELECT 'Admin-Related Params', name, name, NULL, 0 FROM (SELECT DISTINCT name FROM names) WHERE {_ADMIN}
        UNION ALL SELECT 'Forms', concat_ws(' | ', method, action, n_inputs, CASE WHEN csrf_protected THEN 'yes' ELSE 'NO' END),
            found_on, page_id, form_pos FROM form_facts
        UNION ALL SELECT 'Form Risk Flags', action || ' | ' || issues, found_on, page_id, form_pos FROM flags
        UNION ALL SELECT 'Possible Secrets', concat_ws(' | ', type, confidence, value_preview, source), source, page_id, 0 FROM secrets
        UNION ALL SELECT 'Interesting Files', concat_ws(' | ', url, status, content_length), url, NULL, 0 FROM exposed
        UNION ALL SELECT 'HTML Comments', source || ': ' || comment, source, page_id, pos FROM comments""",
    "lines": """SELECT section, row_number() OVER (PARTITION BY section ORDER BY k1, k2 NULLS FIRST, k3) - 1 AS pos, item FROM items""",
}


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(a in ("FROM", "JOIN") and b == name for a, b in zip(words, words[1:])) or f" {name}," in sql


def _oracle(select: str, page: str | None = None) -> str:
    """``select`` with the parts and derived inputs it needs put in front; ``page`` is the page table."""
    parts, needed = list(_PARTS.items()), {select}
    chosen: list[tuple[str, str]] = []
    for name, sql in reversed(parts):
        if any(_mentions(text, name) for text in needed):
            chosen.insert(0, (name, sql))
            needed.add(sql)
    texts = list(needed)
    if page is not None:
        texts.append(page)
        chosen.insert(0, ("full_pages", "SELECT * FROM page WHERE html <> ''"))
        chosen.insert(0, ("page", page))
    inputs = [n for n in TABLES if any(_mentions(text, n) for text in texts)]
    ctes = duckdb_ctes(*inputs) + chosen
    if not ctes:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql})" for n, sql in ctes) + "\n" + select


_RAW = "SELECT page_id, url, html FROM pages"
_DECO = "SELECT page_id, url, html FROM deco"
_GATED_DECO = _gated("deco")
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_IN_SCOPE = " OR ".join(f"{_HOST} = '{d}' OR {_HOST} LIKE '%.{d}'" for d in SCOPE)
_STATIC = "|".join(s[1:] for s in P.STATIC_SUFFIXES)
_ESCAPE = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_KEY = "replace(replace(replace(url, 'https://', ''), 'http://', ''), '/', '_')"
_SUMMARY = """SELECT m.metric, CAST(coalesce(t.n, 0) AS BIGINT) AS value FROM (VALUES
    ('internal_urls', 'internal_urls'), ('js_files', 'js_files'),
    ('api_paths', 'js_endpoint_findings.api_paths'), ('full_urls', 'js_endpoint_findings.full_urls'),
    ('forms', 'forms'), ('risky_forms', 'form_risk_flags'), ('emails', 'emails'), ('params', 'params'),
    ('idor_candidates', 'idor_candidates'), ('secrets', 'secrets'), ('interesting_files', 'interesting_files')
    ) AS m(metric, section) LEFT JOIN totals AS t ON t.section = m.section"""
_NOT_STATIC = f"NOT regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#;]*)', 1)), '\\.({_STATIC})$')"
_ROBOTS = """CASE
            WHEN r.base IS NULL THEN true
            WHEN r.http_status IN (401, 403) THEN false
            WHEN r.http_status BETWEEN 400 AND 499 THEN true
            WHEN r.http_status >= 500 THEN false
            WHEN r.body LIKE '%Disallow: /en/%' THEN NOT p.path LIKE '/en/%'
            WHEN r.body LIKE '%other%' THEN p.path LIKE '/de/%' OR NOT (p.path LIKE '/d%' OR p.path LIKE '/fr/5%')
            ELSE true END AS allowed
        FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base,
            regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages) AS p
        LEFT JOIN robots AS r ON r.base = p.base"""


def _followed(in_scope: str) -> str:
    """Links a crawl follows: those of decorated pages and the derived graph, from pages that robots rules allow."""
    return f"""SELECT DISTINCT src, url AS dst FROM (
            SELECT regexp_extract(page_url, '^[^#]*') AS src, url FROM page_links UNION ALL SELECT src, dst FROM edges) AS l
        WHERE {_NOT_STATIC} AND ({in_scope}) AND src IN (
            SELECT regexp_extract(url, '^[^#]*') FROM (SELECT p.url, {_ROBOTS}) AS judged WHERE allowed)"""


def _full_run() -> str:
    """Summary of the pages that a capped crawl over example.com reaches, with rendered copies and gate."""
    followed = _oracle(_followed(f"{_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com'"), _DECO)
    walked = f"""WITH RECURSIVE followed AS ({followed}),
        walk(url, depth) AS (SELECT regexp_extract(url, '^[^#]*'), 0 FROM pages WHERE page_id % 50 = 0
        UNION SELECT f.dst, w.depth + 1 FROM walk AS w JOIN followed AS f ON f.src = w.url WHERE w.depth < 6)
        SELECT url FROM (SELECT url, min(depth) AS depth FROM walk GROUP BY url) ORDER BY depth, url LIMIT (SELECT greatest(count(*) // 10, 1) FROM nodes)"""
    reached = f"""(SELECT d.page_id, d.url, d.status, d.content_type, coalesce(r.html, d.html) AS html
        FROM deco AS d LEFT JOIN rendered AS r ON r.url = d.url
        WHERE regexp_extract(d.url, '^[^#]*') IN ({walked})) AS reached"""
    whole = _oracle(_SUMMARY, _gated(reached))
    return whole.replace("', 1) FROM pages)", "', 1) FROM page)")  # well-known paths of reached hosts only


_CRAWL = """SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url"""
_WALK = """walk(url, depth) AS (SELECT url, 0 FROM nodes WHERE page_id % 50 = 0
    UNION SELECT e.dst, w.depth + 1 FROM walk AS w JOIN edges AS e ON e.src = w.url WHERE w.depth < 6)"""


def _crawl_oracle(select: str) -> str:
    ctes = ",\n".join(f"{n} AS ({sql})" for n, sql in duckdb_ctes("nodes", "edges"))
    return f"WITH RECURSIVE {ctes},\n{_WALK}\n{select}"


ORACLES = {
    "pages_scan": "SELECT page_id, url, html FROM pages",
    "content_gate": _oracle(f"SELECT page_id, url, status, html FROM ({_GATED_DECO})"),
    "nonempty_pages": _oracle("SELECT page_id, url, status FROM page WHERE html <> ''", _GATED_DECO),
    "page_errors_latest": _oracle("SELECT url, error FROM last_errors"),
    "render_overlay": _oracle(
        "SELECT d.page_id, d.url, coalesce(r.html, d.html) AS html FROM deco AS d LEFT JOIN rendered AS r ON r.url = d.url"
    ),
    "js_asset_join": _oracle("SELECT source, body FROM asset_texts", _DECO),
    "url_domain": f"SELECT page_id, lower({_HOST}) AS domain FROM pages",
    "root_domain": f"""SELECT page_id, array_to_string(list_slice(string_split(lower({_HOST}), '.'), -2, -1), '.') AS root_domain
        FROM pages""",
    "url_base": "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base FROM pages",
    "target_key": f"SELECT page_id, {_KEY} AS target_key, left({_KEY}, 150) AS screenshot_key FROM pages",
    "clean_params": _oracle(
        r"SELECT source, name, regexp_replace(name, '[^a-zA-Z0-9_\-\[\]]', '', 'g') AS cleaned FROM form_names"
        r" UNION ALL SELECT source, name, regexp_replace(name, '[^a-zA-Z0-9_\-\[\]]', '', 'g') FROM url_params",
        _DECO,
    ),
    "resolved_links": _oracle(f"SELECT page_url, pos, tag, href, {_resolved('href')} AS url FROM links", _DECO),
    "internal_urls": "SELECT DISTINCT url FROM pages",
    "page_links": _oracle("SELECT page_url, url FROM page_links", _RAW),
    "js_files": _oracle("SELECT page_url, js_url FROM js", _DECO),
    "inline_scripts": _oracle("SELECT page_url, pos, body FROM inline", _RAW),
    "inline_scripts_decorated": _oracle("SELECT page_url, pos, body FROM inline", _DECO),
    "html_comments": _oracle("SELECT source, pos, comment FROM comments", _RAW),
    "emails": _oracle("SELECT source, email FROM emails", _RAW),
    "emails_documents": _emails("documents", "text", "doc_id AS source"),
    "url_params": _oracle("SELECT source, name FROM url_params", _RAW),
    "forms": _oracle(
        "SELECT found_on, form_pos, action, method, n_inputs, csrf_protected FROM form_facts", _DECO
    ),
    "form_fields": _oracle("SELECT found_on, form_pos, field_pos, name, type FROM fields", _DECO),
    "form_params": _oracle("SELECT source, name FROM form_names", _DECO),
    "secrets_documents": "SELECT source, type, confidence, value_preview, entropy FROM ("
    + _secrets("(SELECT doc_id AS page_id, doc_id AS source, text AS body FROM documents)")
    + ")",
    "secrets_pages": _oracle("SELECT source, type, confidence, value_preview, entropy FROM secrets", _DECO),
    "endpoints_all": _oracle("SELECT DISTINCT source, category, value FROM endpoints", _DECO),
    **{
        f"endpoints_{category}": _oracle(
            f"SELECT DISTINCT source, value FROM endpoints WHERE category = '{category}'", _DECO
        )
        for category in P.ENDPOINT_PATTERNS
    },
    "static_asset_filter": _oracle(
        f"""SELECT page_url, url FROM page_links
        WHERE NOT regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#;]*)', 1)), '\\.({_STATIC})$')""",
        _DECO,
    ),
    "in_scope_links": _oracle(f"SELECT page_url, url FROM page_links WHERE {_IN_SCOPE}", _DECO),
    "valid_targets": _oracle(
        f"""SELECT page_url, pos, url FROM (SELECT page_url, pos, {_resolved('href')} AS url FROM links)
        WHERE url LIKE 'http:%' OR url LIKE 'https:%'""",
        _DECO,
    ),
    "rejected_targets": _oracle(
        f"""SELECT url, 'not a web address: scheme is not http or https' AS error
        FROM (SELECT {_resolved('href')} AS url FROM links) WHERE NOT (url LIKE 'http:%' OR url LIKE 'https:%')""",
        _DECO,
    ),
    "unvisited_links": _oracle(
        """SELECT url, src FROM (SELECT url, page_url AS src FROM page_links UNION ALL SELECT dst, src FROM edges)
        WHERE url NOT IN (SELECT url FROM pages)""",
        _RAW,
    ),
    "exposed_files": _oracle("SELECT url, status, content_length FROM exposed"),
    "robots_allowed": _oracle(f"SELECT p.page_id, p.url, {_ROBOTS}"),
    "crawl_depth": _crawl_oracle(_CRAWL),
    "crawl_depth_bucketed": _crawl_oracle(_CRAWL),
    "crawl_frontier_batches": _crawl_oracle(_CRAWL),
    "crawl_capped": _crawl_oracle(f"SELECT url, depth FROM ({_CRAWL}) ORDER BY depth, url LIMIT (SELECT greatest(count(*) // 10, 1) FROM nodes)"),
    "param_flags": _oracle(
        f"SELECT DISTINCT name, {_IDOR} AS is_idor, {_ADMIN} AS is_admin FROM names", _DECO
    ),
    "form_flags": _oracle("SELECT action, found_on, form_pos, method, issues FROM flags", _DECO),
    "form_flag_counts": _oracle("SELECT issue, count(*) AS n_forms FROM issues GROUP BY issue", _DECO),
    "distinct_findings": _oracle("SELECT section, category, value, n FROM once", _GATED_DECO),
    "endpoints_merged": _oracle(
        "SELECT category, count(DISTINCT value) AS n_values FROM endpoints GROUP BY category", _GATED_DECO
    ),
    "findings_doc": _oracle("SELECT section, n FROM totals", _GATED_DECO),
    "doc_sets": _oracle(
        f"""SELECT section, category, value FROM once
        UNION ALL SELECT 'idor_candidates', '', name FROM (SELECT DISTINCT name FROM names) WHERE {_IDOR}
        UNION ALL SELECT 'admin_param_candidates', '', name FROM (SELECT DISTINCT name FROM names) WHERE {_ADMIN}""",
        _GATED_DECO,
    ),
    "doc_forms": _oracle(
        "SELECT page_id AS page_key, found_on, action, method, n_inputs, csrf_protected FROM form_facts", _GATED_DECO
    ),
    "doc_flags": _oracle("SELECT page_id AS page_key, found_on, action, method, issues FROM flags", _GATED_DECO),
    "doc_secrets": _oracle("SELECT source, type, confidence, value_preview FROM secrets", _GATED_DECO),
    "doc_comments": _oracle("SELECT page_id AS page_key, source, comment FROM comments", _GATED_DECO),
    "doc_files": _oracle("SELECT url, CAST(status AS INTEGER) AS status, content_length FROM exposed"),
    "doc_errors": _oracle("SELECT url, error FROM last_errors"),
    "crawl_edges": _oracle(_followed(_IN_SCOPE), _DECO),
    "full_run_summary": _full_run(),
    "summary_counts": _oracle(_SUMMARY, _GATED_DECO),
    "report_sections": _oracle("SELECT section, pos, item FROM lines", _GATED_DECO),
    "section_counts": _oracle("SELECT section, count(*) AS n FROM items GROUP BY section", _GATED_DECO),
    "escaped_sections": _oracle(
        f"SELECT section, pos, {_ESCAPE.format('item')} AS item FROM lines", _GATED_DECO
    ),
    "escaped_html": f"SELECT page_id, {_ESCAPE.format('html')} AS escaped FROM pages",
    "stream_findings": _oracle(
        f"""SELECT section, category, source, page_key, value, confidence, method, issues FROM (
        SELECT 'internal_urls' AS section, '' AS category, url AS source, page_id AS page_key, url AS value,
            {_EMPTY} AS confidence, {_EMPTY} AS method, {_EMPTY} AS issues FROM page
        UNION ALL SELECT 'comments', '', source, page_id, comment, {_EMPTY}, {_EMPTY}, {_EMPTY} FROM comments
        UNION ALL SELECT 'js_files', '', page_url, page_id, js_url, {_EMPTY}, {_EMPTY}, {_EMPTY} FROM js
        UNION ALL SELECT 'emails', '', source, page_id, email, {_EMPTY}, {_EMPTY}, {_EMPTY} FROM emails
        UNION ALL SELECT 'params', '', source, page_id, name, {_EMPTY}, {_EMPTY}, {_EMPTY} FROM url_params
        UNION ALL SELECT DISTINCT 'params', '', source, page_id, name, {_EMPTY}, {_EMPTY}, {_EMPTY} FROM form_names
        UNION ALL SELECT 'forms', '', found_on, page_id, action, {_EMPTY}, method, {_EMPTY} FROM form_facts
        UNION ALL SELECT 'form_risk_flags', '', found_on, page_id, action, {_EMPTY}, method, issues FROM flags
        UNION ALL SELECT DISTINCT 'js_endpoint_findings', category, source, page_id, value, {_EMPTY}, {_EMPTY}, {_EMPTY}
            FROM endpoints WHERE page_id IS NOT NULL
        UNION ALL SELECT 'secrets', type, source, page_id, value_preview, confidence, {_EMPTY}, {_EMPTY}
            FROM secrets WHERE page_id IS NOT NULL) AS every""",
        _GATED_DECO,
    ),
    "stream_visited": _oracle("SELECT DISTINCT url FROM page_links", _RAW),
    "findings_merged_runs": _oracle(
        """SELECT section, category, value, n FROM once WHERE section <> 'js_endpoint_findings'
        UNION ALL SELECT 'js_endpoint_findings', category, value, count(*) FROM (
            SELECT DISTINCT page_id, source, category, value FROM page_endpoints) GROUP BY category, value""",
        _GATED_DECO,
    ),
    "stream_visited_batches": _oracle("SELECT DISTINCT url FROM page_links WHERE url IS NOT NULL", _RAW),
}
