"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.catalog.fixtures import SCOPE, TARGET, table
from webcorpus.functions import markup, patterns, urls
from webcorpus.operators import assets, classify, crawl, exposure, extract, robots, scope
from webcorpus.plans import findings, report, run
from webcorpus.session import new_folder
from webcorpus.sources import captures
from webcorpus.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _pages(spark, sf_dir):
    return captures.read_pages(spark, f"{sf_dir}/pages.parquet")


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _deco(spark, sf_dir):
    return table(spark, sf_dir, "deco").select("page_id", "url", "html")


def _captures(spark, sf_dir, stream=None):
    """Decorated pages with status and headers; a missing content type is a missing header."""
    headers = F.when(F.col("content_type") != "", F.create_map(F.lit("Content-Type"), F.col("content_type")))
    decorated = table(spark, sf_dir, "deco", stream)
    return decorated.select("page_id", "url", "status", "html", headers.alias("headers"))


def _scope(spark):
    return spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in SCOPE])).alias("domain"))


def _assets(spark, sf_dir):
    return assets.js_asset_join(extract.js_files(_deco(spark, sf_dir)), table(spark, sf_dir, "js_assets"))


def _dictionary(spark, sf_dir):
    return assets.script_dictionary(extract.js_files(_deco(spark, sf_dir)), table(spark, sf_dir, "js_assets"))


def _searched_scripts(spark, sf_dir, search):
    """``search`` over inline blocks and captured assets; each distinct asset body is searched once."""
    inline = extract.inline_scripts(_deco(spark, sf_dir)).select(F.col("page_url").alias("source"), "body")
    return search(inline).unionByName(assets.searched(_dictionary(spark, sf_dir), search))


def _exposed(spark, sf_dir):
    responses = table(spark, sf_dir, "responses").select(
        "url", "status",
        F.when(F.col("content_length").isNotNull(), F.create_map(F.lit("Content-Length"), F.col("content_length"))).alias("headers"),
    )
    return exposure.exposed_files(responses, _pages(spark, sf_dir).select("url"))


def _errors(spark, sf_dir):
    return captures.page_errors_latest(table(spark, sf_dir, "fetch_log"))


def _findings(spark, sf_dir):
    return findings.corpus_findings(
        captures.content_gate(_captures(spark, sf_dir)),
        js_assets=table(spark, sf_dir, "js_assets"),
        exposed=_exposed(spark, sf_dir),
        errors=_errors(spark, sf_dir),
    )


# --- Sources -----------------------------------------------------------------------------------------


@query
def pages_scan(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", "html")


@query
def content_gate(spark, sf_dir):
    return captures.content_gate(_captures(spark, sf_dir)).select("page_id", "url", "status", "html")


@query
def nonempty_pages(spark, sf_dir):
    gated = captures.content_gate(_captures(spark, sf_dir))
    return extract.nonempty_pages(gated).select("page_id", "url", "status")


@query
def page_errors_latest(spark, sf_dir):
    return _errors(spark, sf_dir)


@query
def render_overlay(spark, sf_dir):
    return assets.render_overlay(_deco(spark, sf_dir), table(spark, sf_dir, "rendered"))


@query
def js_asset_join(spark, sf_dir):
    return _assets(spark, sf_dir)


# --- URLs --------------------------------------------------------------------------------------------


@query
def url_domain(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.domain(F.col("url")).alias("domain"))


@query
def root_domain(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.root_domain(F.col("url")).alias("root_domain"))


@query
def url_base(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.base_of(F.col("url")).alias("base"))


@query
def target_key(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id",
        urls.capture_key(F.col("url")).alias("target_key"),
        urls.capture_key(F.col("url"), patterns.CAPTURE_KEY_CUT).alias("screenshot_key"),
    )


@query
def clean_params(spark, sf_dir):
    pages = _deco(spark, sf_dir)
    names = extract.url_params(pages).unionByName(extract.form_params(extract.forms(pages)))
    return names.select("source", "name", urls.clean_param_name(F.col("name")).alias("cleaned"))


@query
def resolved_links(spark, sf_dir):
    return extract.resolved_links(_deco(spark, sf_dir))


@query
def internal_urls(spark, sf_dir):
    return extract.internal_urls(_pages(spark, sf_dir))


# --- Extractors --------------------------------------------------------------------------------------


@query
def page_links(spark, sf_dir):
    return extract.page_links(captures.spread(_pages(spark, sf_dir)))


@query
def js_files(spark, sf_dir):
    return extract.js_files(_deco(spark, sf_dir))


@query
def inline_scripts(spark, sf_dir):
    return extract.inline_scripts(_pages(spark, sf_dir))


@query
def inline_scripts_decorated(spark, sf_dir):
    return extract.inline_scripts(_deco(spark, sf_dir))


@query
def html_comments(spark, sf_dir):
    return extract.html_comments(_pages(spark, sf_dir))


@query
def emails(spark, sf_dir):
    return extract.emails(_pages(spark, sf_dir))


@query
def emails_documents(spark, sf_dir):
    return extract.emails(_documents(spark, sf_dir), text="text", source="doc_id")


@query
def url_params(spark, sf_dir):
    return extract.url_params(_pages(spark, sf_dir))


@query
def forms(spark, sf_dir):
    return extract.forms(_deco(spark, sf_dir)).select(
        "found_on", "form_pos", "action", "method", F.size("inputs").alias("n_inputs"), "csrf_protected"
    )


@query
def form_fields(spark, sf_dir):
    return extract.form_fields(extract.forms(_deco(spark, sf_dir)))


@query
def form_params(spark, sf_dir):
    return extract.form_params(extract.forms(_deco(spark, sf_dir)))


@query
def secrets_documents(spark, sf_dir):
    documents = captures.spread(_documents(spark, sf_dir))
    texts = documents.select(F.col("doc_id").alias("source"), F.col("text").alias("body"))
    return extract.secrets(texts)


@query
def secrets_pages(spark, sf_dir):
    pages = _deco(spark, sf_dir)
    raw = pages.select(F.col("url").alias("source"), F.col("html").alias("body"))
    inline = extract.inline_scripts(pages).select(
        F.concat("page_url", F.lit(" (inline script)")).alias("source"), "body"
    )
    return extract.secrets(raw.unionByName(inline)).unionByName(assets.searched(_dictionary(spark, sf_dir), extract.secrets))


@query
def endpoints_all(spark, sf_dir):
    return _searched_scripts(spark, sf_dir, extract.endpoints).distinct()


def _endpoints_query(category):
    def run(spark, sf_dir):
        found = _searched_scripts(spark, sf_dir, lambda scripts: extract.endpoints(scripts, (category,)))
        return found.select("source", "value").distinct()

    return run


for _category in patterns.ENDPOINT_PATTERNS:
    QUERIES[f"endpoints_{_category}"] = _endpoints_query(_category)


# --- Filters and joins -------------------------------------------------------------------------------


@query
def static_asset_filter(spark, sf_dir):
    return scope.without_static_assets(extract.page_links(_deco(spark, sf_dir)))


@query
def in_scope_links(spark, sf_dir):
    return scope.in_scope(extract.page_links(_deco(spark, sf_dir)), _scope(spark))


@query
def valid_targets(spark, sf_dir):
    return scope.valid_targets(extract.resolved_links(_deco(spark, sf_dir))).select("page_url", "pos", "url")


@query
def rejected_targets(spark, sf_dir):
    return scope.rejected_targets(extract.resolved_links(_deco(spark, sf_dir)))


@query
def unvisited_links(spark, sf_dir):
    edges = table(spark, sf_dir, "edges").select(F.col("dst").alias("url"), "src")
    links = extract.page_links(_pages(spark, sf_dir)).select("url", F.col("page_url").alias("src"))
    return scope.unvisited(links.unionByName(edges), _pages(spark, sf_dir))


@query
def exposed_files(spark, sf_dir):
    return _exposed(spark, sf_dir)


@query
def robots_allowed(spark, sf_dir):
    return robots.robots_allowed(_pages(spark, sf_dir).select("page_id", "url"), table(spark, sf_dir, "robots"))


# --- Link graph --------------------------------------------------------------------------------------


CAP_SHARE = 10  # the page cap is a tenth of the pages, so that the capped crawl grows with the table


def _cap(spark, sf_dir):
    return max(1, table(spark, sf_dir, "nodes").count() // CAP_SHARE)


def _start(spark, sf_dir):
    """Starts all over the graph, so that what is reached grows with the table."""
    return table(spark, sf_dir, "nodes").filter("page_id % 50 = 0").select("url")


def _known_links(spark, sf_dir):
    return table(spark, sf_dir, "edges").select(F.col("src").alias("page_url"), F.col("dst").alias("url"))


@query
def crawl_edges(spark, sf_dir):
    return crawl.crawl_edges(
        _deco(spark, sf_dir), _scope(spark), table(spark, sf_dir, "robots"), known_links=_known_links(spark, sf_dir)
    )


@query
def crawl_depth(spark, sf_dir):
    return crawl.crawl_depth(table(spark, sf_dir, "edges"), _start(spark, sf_dir), max_depth=6)


@query
def crawl_depth_bucketed(spark, sf_dir):
    """``crawl_depth`` over edges bucketed by source: levels past the broadcast bound move the frontier only."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return crawl.crawl_depth(table(spark, sf_dir, "edges"), _start(spark, sf_dir), max_depth=6, buckets=buckets)


@query
def crawl_frontier_batches(spark, sf_dir):
    """``crawl_depth`` kept up to date as the edges arrive as a stream, in four micro-batches dealt by source."""
    folder = new_folder(spark, "crawl-frontier")
    table(spark, sf_dir, "edges").repartition(4, "src").write.parquet(f"{folder}/arriving")
    arriving = spark.readStream.schema("src string, dst string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    return ingest.crawl_frontier(arriving, _start(spark, sf_dir), folder, max_depth=6)


@query
def crawl_capped(spark, sf_dir):
    return crawl.crawl_capped(table(spark, sf_dir, "edges"), _start(spark, sf_dir), max_depth=6, max_pages=_cap(spark, sf_dir))


# --- Classification ----------------------------------------------------------------------------------


@query
def param_flags(spark, sf_dir):
    pages = _deco(spark, sf_dir)
    return classify.param_flags(
        extract.url_params(pages).unionByName(extract.form_params(extract.forms(pages)))
    )


@query
def form_flags(spark, sf_dir):
    flags = classify.form_flags(extract.forms(_deco(spark, sf_dir)))
    return flags.select("action", "found_on", "form_pos", "method", F.array_join("issues", ", ").alias("issues"))


@query
def form_flag_counts(spark, sf_dir):
    return classify.form_flag_counts(classify.form_flags(extract.forms(_deco(spark, sf_dir))))


# --- Findings and reports ----------------------------------------------------------------------------


@query
def distinct_findings(spark, sf_dir):
    return findings.distinct_findings(_findings(spark, sf_dir))


@query
def endpoints_merged(spark, sf_dir):
    return findings.endpoints_merged(_findings(spark, sf_dir))


@query
def findings_doc(spark, sf_dir):
    return findings.findings_doc(_findings(spark, sf_dir))


def _document(spark, sf_dir):
    return report.document_rows(_findings(spark, sf_dir))


@query
def doc_sets(spark, sf_dir):
    return _document(spark, sf_dir).filter(F.col("value").isNotNull()).select("section", "category", "value")


@query
def doc_forms(spark, sf_dir):
    return _document(spark, sf_dir).filter("section = 'forms'").select(
        "page_key", "found_on", "action", "method", F.size("inputs").alias("n_inputs"), "csrf_protected"
    )


@query
def doc_flags(spark, sf_dir):
    return _document(spark, sf_dir).filter("section = 'form_risk_flags'").select(
        "page_key", "found_on", "action", "method", F.array_join("issues", ", ").alias("issues")
    )


@query
def doc_secrets(spark, sf_dir):
    found = _document(spark, sf_dir).filter("section = 'secrets'")
    return found.select("source", "type", "confidence", "value_preview")


@query
def doc_comments(spark, sf_dir):
    return _document(spark, sf_dir).filter("section = 'comments'").select("page_key", "source", "comment")


@query
def doc_files(spark, sf_dir):
    return _document(spark, sf_dir).filter("section = 'interesting_files'").select("url", "status", "content_length")


@query
def doc_errors(spark, sf_dir):
    return _document(spark, sf_dir).filter("section = 'errors'").select("url", "error")


@query
def full_run_summary(spark, sf_dir):
    """A run over one target's domain: crawl, rendered copies, gate and findings of the pages reached."""
    responses = table(spark, sf_dir, "responses").select(
        "url", "status",
        F.when(F.col("content_length").isNotNull(), F.create_map(F.lit("Content-Length"), F.col("content_length"))).alias("headers"),
    )
    found = run.full_run(
        _captures(spark, sf_dir),
        scope.allowed_domains(spark, TARGET),
        _start(spark, sf_dir),
        max_depth=6,
        max_pages=_cap(spark, sf_dir),
        robots_files=table(spark, sf_dir, "robots"),
        known_links=_known_links(spark, sf_dir),
        rendered=table(spark, sf_dir, "rendered"),
        js_assets=table(spark, sf_dir, "js_assets"),
        responses=responses,
        errors=_errors(spark, sf_dir),
    )
    return findings.summary_counts(found, files_checked=True)


@query
def summary_counts(spark, sf_dir):
    return findings.summary_counts(_findings(spark, sf_dir), files_checked=True)


@query
def report_sections(spark, sf_dir):
    return report.report_sections(_findings(spark, sf_dir))


@query
def section_counts(spark, sf_dir):
    return report.section_counts(_findings(spark, sf_dir))


@query
def escaped_sections(spark, sf_dir):
    return report.escaped_sections(report.report_sections(_findings(spark, sf_dir)))


@query
def escaped_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", markup.escape_html(F.col("html")).alias("escaped"))


# --- Streams -----------------------------------------------------------------------------------------


def _page_stream(spark, sf_dir):
    return ingest.page_stream(spark, f"{sf_dir}/page[s].parquet", captures.PAGE_SCHEMA)


@query
def stream_findings(spark, sf_dir):
    """The findings of decorated, gated pages that arrive as a stream."""
    gated = captures.content_gate(_captures(spark, sf_dir, _page_stream(spark, sf_dir)))
    stored = ingest.run_available(ingest.stream_findings(gated), new_folder(spark, "stream-findings"))
    return stored.select(
        "section", "category", "source", "page_key", "value", "confidence",
        F.col("form.method").alias("method"), F.array_join("issues", ", ").alias("issues"),
    )


@query
def stream_visited(spark, sf_dir):
    links = ingest.linked_urls(_page_stream(spark, sf_dir))
    return ingest.run_available(ingest.visited_urls(links), new_folder(spark, "stream-visited"))


@query
def stream_visited_batches(spark, sf_dir):
    """The visited set of the page stream in two levels: distinct within a micro-batch, then against the stored set."""
    links = ingest.linked_urls(_page_stream(spark, sf_dir))
    folder = new_folder(spark, "stream-visited")
    table = "visited_" + folder.rsplit("-", 1)[-1]
    return ingest.visited_in_batches(links, table, folder).select("url")


@query
def findings_merged_runs(spark, sf_dir):
    """Page findings of two capture runs merged into a stored set; every page belongs to one run, by the sign of its URL's hash."""
    pages = captures.content_gate(_captures(spark, sf_dir))
    first = F.coalesce(F.xxhash64("url") < 0, F.lit(False))
    folder = new_folder(spark, "findings-store")
    table = "findings_" + folder.rsplit("-", 1)[-1]
    for run_name, half in (("first", pages.where(first)), ("second", pages.where(~first))):
        merged = findings.merge_findings(findings.page_findings(half), table, folder, run_name)
    return merged
