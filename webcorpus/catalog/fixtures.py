"""Inputs that the given tables lack, derived from ``pages`` by SQL that runs on Spark and DuckDB alike.

Every page gets markup of its own (forms, scripts, links), and captures of other kinds (script assets,
responses, robots files, errors, rendered copies) are computed from the page URLs, so all of them grow with
the table. Texts use no backslashes, because the two dialects read them differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webcorpus.functions.patterns import WELL_KNOWN_PATHS
from webcorpus.sources import captures

_PATHS = ", ".join(f"'{path}'" for path in (*WELL_KNOWN_PATHS, "index.html"))

# name -> SQL text over pages and the entries above it; @each(...) makes one row per argument
TABLES = {
    "deco": """
SELECT page_id, url, replace(html, '<body>', concat('<body>', extra)) AS html,
  CAST(CASE WHEN page_id % 10 = 3 THEN 404 WHEN page_id % 17 = 5 THEN 500 ELSE 200 END AS INT) AS status,
  CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN '' WHEN 2 THEN 'application/json'
    ELSE 'text/html; charset=utf-8' END AS content_type
FROM (SELECT page_id, url, html, concat(
  CASE page_id % 3
    WHEN 0 THEN '<form action="/login?next=1#f" method="post"><input name="user_id"><input type="password" name="passwd"></form>'
    WHEN 1 THEN '<form method="GET"><input name="password"><select name="role"><option>x</option></select></form>'
    ELSE '<form action="/up" method="POST"><input type="file" name="doc"><textarea name="csrf_token"></textarea></form>' END,
  CASE WHEN page_id % 2 = 0 THEN concat('<script src="/static/app', CAST(page_id % 5 AS STRING), '.js"></script>') ELSE '' END,
  CASE WHEN page_id % 4 = 0 THEN concat('<script>var a="/api/v', CAST(page_id % 3 AS STRING), '/users";var g="/graphql/q";var w="wss://ws', CAST(page_id % 2 AS STRING), '.example.com/s";var b="bkt', CAST(page_id % 8 AS STRING), '.s3.us-east-1.amazonaws.com";var f="proj.firebaseio.com";var d="/docs/openapi.json";var u="https://cdn.example.org/x', CAST(page_id % 6 AS STRING), '";</script>') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN '<link href="/main.css"><area href="/map#x"><a data-href="/no" href="/logo.png">l</a><a href="mailto:team@example.com">m</a><a href="//m.example.net/p?debug_mode=1&amp;id=2">x</a>' ELSE '' END,
  CASE WHEN page_id % 7 = 0 THEN concat('<script>var token = "', md5(CAST(page_id AS STRING)), '";</script>') ELSE '' END) AS extra
  FROM pages) AS snippets""",
    "bases": "SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base FROM pages",
    # Script assets: one per base and script number, two thirds of the numbers with status 200.
    "js_assets": """
SELECT url, CAST(CASE WHEN url LIKE '%app4.js' THEN 404 ELSE 200 END AS INT) AS status,
  concat('fetch("/rest/', substr(md5(url), 1, 2), '/list");var s="https://static.example.org/', substr(md5(url), 3, 1),
    '";var api_key = "', md5(url), '";') AS body
FROM (SELECT DISTINCT concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/static/app', CAST(page_id % 5 AS STRING), '.js') AS url
  FROM pages) AS scripts""",
    "rendered": """
SELECT url, replace(html, '<title>', '<title>Rendered ') AS html FROM deco WHERE url LIKE 'https:%'""",
    "fetch_log": """
SELECT concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/down') AS url,
  CASE WHEN page_id % 9 = 4 THEN CAST(NULL AS STRING) ELSE concat('timeout ', CAST(page_id AS STRING)) END AS error,
  CAST(concat('2024-01-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), ' 00:00:00') AS TIMESTAMP) AS ts
FROM pages""",
    "responses": f"""
SELECT url, CAST(CASE WHEN mark < '6' THEN 200 WHEN mark < 'a' THEN 404 WHEN mark = 'a' THEN 301 ELSE 403 END AS INT) AS status,
  CASE WHEN substr(md5(url), 2, 1) < '8' THEN CAST(length(url) AS STRING) END AS content_length
FROM (SELECT url, substr(md5(url), 1, 1) AS mark
  FROM (SELECT concat(base, '/', path) AS url FROM (SELECT base, @each({_PATHS}) AS path
    FROM (SELECT base FROM bases UNION ALL SELECT concat(base, '.unlisted.example') AS base FROM bases) AS b) AS p) AS u) AS r""",
    "robots": """
SELECT base, CAST(CASE mark WHEN '7' THEN 404 WHEN '8' THEN 401 WHEN '9' THEN 500 ELSE 200 END AS INT) AS http_status,
  CASE WHEN mark < '4' THEN concat('User-agent: *', chr(10), 'Disallow: /en/', chr(10), 'Allow: /en/7', chr(10))
    WHEN mark < '7' THEN concat('User-agent: other', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: WebCorpus # us', chr(10),
      'Allow: /de/', chr(10), 'Disallow: /d', chr(10), 'Disallow: /fr/%35', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
    WHEN mark < 'a' THEN 'User-agent: *'
    ELSE concat('User-agent: *', chr(10), 'Disallow:', chr(10), '# note', chr(10), 'Disallow: /fr') END AS body
FROM (SELECT base, substr(md5(base), 1, 1) AS mark FROM bases) AS m WHERE mark < 'd'""",
    "nodes": "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages",
    "hops": """
SELECT url, (page_id * 2 + 1) % (SELECT count(*) FROM pages) AS next_id FROM nodes
UNION ALL SELECT url, (page_id * 3 + 2) % (SELECT count(*) FROM pages) AS next_id FROM nodes""",
    "edges": "SELECT DISTINCT h.url AS src, n.url AS dst FROM hops AS h JOIN nodes AS n ON n.page_id = h.next_id",
}

TARGET = "https://example.com/"
SCOPE = ("example.com", "ththan.example.net", "blog.ththan.example.net")


def _needed(name: str) -> list[str]:
    """``name`` and the entries it reads, in definition order."""
    names, wanted = list(TABLES), {name}
    for entry in reversed(names[: names.index(name) + 1]):
        if entry in wanted:
            words = TABLES[entry].replace("(", " ").replace(")", " ").split()
            wanted |= {n for n in names if n in words}
    return [n for n in names if n in wanted]


def _each(text: str, opening: str) -> str:
    """Spell ``@each(...)`` as a dialect's generator over an array."""
    return text.replace("@each(", opening).replace(") AS path", ")) AS path") if "@each(" in text else text


def duckdb_ctes(*names: str) -> list[tuple[str, str]]:
    wanted = {n for name in names for n in _needed(name)}
    return [(n, _each(text, "unnest(list_value(")) for n, text in TABLES.items() if n in wanted]


def table(spark: SparkSession, sf_dir: str, name: str, stream: DataFrame | None = None) -> DataFrame:
    """A table derived from ``pages``, or from a stream of them."""
    ctes = ", ".join(f"{n} AS ({_each(TABLES[n], 'explode(array(')})" for n in _needed(name))
    pages = captures.read_pages(spark, f"{sf_dir}/pages.parquet") if stream is None else stream
    if name == "deco" and stream is None:  # the input of the html searches
        pages = captures.spread(pages)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}".replace("FROM pages", "FROM {pages}"), pages=pages)
