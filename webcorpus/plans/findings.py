"""All findings of a corpus in one long table, from one scan of the pages.

``section, category, source, page_key, pos, value, confidence, form, issues`` with one row per finding. Each
page is searched once: its findings are gathered as one array and exploded, so neither the html nor any
intermediate is shuffled, and every report reads this (small) table instead of the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import extracted, forms, markup, patterns, texts, urls
from webcorpus.functions.text_sql import quoted
from webcorpus.operators import assets
from webcorpus.session import written

# Section names. Those whose values are a set over the whole corpus; the others are bags.
SET_SECTIONS = ("internal_urls", "js_files", "js_endpoint_findings", "emails", "params")

_FORM = "struct<method:string,inputs:array<struct<name:string,type:string>>,csrf_protected:boolean>"
COLUMNS = ("section", "category", "source", "page_key", "pos", "value", "confidence", "form", "issues")


def _finding(
    section: str,
    value: str,
    pos: str = "0",
    source: str = "url",
    category: str = "''",
    confidence: str = "cast(NULL AS string)",
    form: str = f"cast(NULL AS {_FORM})",
    issues: str = "cast(NULL AS array<string>)",
    parts: str | None = None,
) -> str:
    return f"""struct({quoted(section)} AS section, {category} AS category, {source} AS source, {pos} AS pos,
        {value} AS value, {confidence} AS confidence, {form} AS form, {issues} AS issues{parts or ''})"""


def _secret(hit: str, source: str, pos: str, parts: str | None = None) -> str:
    return _finding(
        "secrets", f"{hit}.value_preview", pos, source, f"{hit}.type", f"{hit}.confidence", parts=parts
    )


_NO_PARTS = ", cast(NULL AS array<string>) AS parts"


def _page_sections() -> list[str]:
    """SQL of one array of findings per extractor, over the columns of a prepared page; the forms as their tags."""
    simple = [("js_files", "js_urls"), ("emails", "emails"), ("comments", "comments"), ("params", "url_params")]
    found = [
        f"transform({column}, (v, i) -> {_finding(section, 'v', 'i', parts=_NO_PARTS)})" for section, column in simple
    ]
    found += [
        f"transform(html_secrets, (h, i) -> {_secret('h', 'url', 'i', _NO_PARTS)})",
        "transform(script_secrets, (h, i) -> " + _secret("h", "concat(url, ' (inline script)')", "i", _NO_PARTS) + ")",
        "transform(endpoints, (e, i) -> "
        + _finding("js_endpoint_findings", "e.value", "i", category="e.category", parts=_NO_PARTS)
        + ")",
        f"IF(size(form_parts) > 0, array({_finding('', 'url', parts=', form_parts AS parts')}), NULL)",
    ]
    return found


def _form_sections() -> list[str]:
    """The same for the assembled ``forms`` of the page ``source``."""
    form = "struct({0}.method AS method, {0}.inputs AS inputs, {0}.csrf_protected AS csrf_protected)"
    here = {"source": "source"}
    return [
        f"transform(forms, (f, i) -> {_finding('forms', 'f.action', 'i', form=form.format('f'), **here)})",
        "transform(filter(transform(forms, (f, i) -> struct(i AS i, f AS f)), e -> size(e.f.issues) > 0), e -> "
        + _finding("form_risk_flags", "e.f.action", "e.i", form=form.format("e.f"), issues="e.f.issues", **here)
        + ")",
        "transform(array_remove(array_distinct(flatten(transform(forms, f -> f.inputs.name))), ''), (v, i) -> "
        + _finding("params", "v", "i", **here)
        + ")",
    ]


def _prepared(pages: DataFrame, key: str | None) -> DataFrame:
    """Pages with every finding as an array column, html gone."""
    page_key = F.col(key).cast("bigint") if key else F.lit(None).cast("bigint")
    text = F.when(F.length("html") > 0, F.col("html"))  # NULL skips every extractor of an empty page
    cut = pages.select("url", page_key.alias("page_key"), text.alias("html")).withColumns(
        {
            "base": urls.base_parts("url"),
            "scripts": extracted.script_elements("html"),
        }
    )
    cut = cut.withColumn("bodies", extracted.inline_bodies("scripts"))
    return cut.select(
        "url",
        "page_key",
        extracted.script_urls("scripts", "base").alias("js_urls"),
        texts.emails("html").alias("emails"),
        texts.telling_comments("html").alias("comments"),
        F.when(F.col("html").isNotNull(), urls.param_names(F.col("url"))).alias("url_params"),
        F.expr(texts.secrets_sql("html")).alias("html_secrets"),
        F.expr(f"flatten(transform(bodies, b -> {texts.secrets_sql('b')}))").alias("script_secrets"),
        F.expr(f"array_distinct(flatten(transform(bodies, b -> {texts.endpoints_sql('b')})))").alias("endpoints"),
        markup.form_parts("html").alias("form_parts"),
    )


def _with_forms(found: DataFrame) -> DataFrame:
    """Findings with ``forms``, assembled where a row holds the form tags of a page."""
    base = F.when(F.col("parts").isNotNull(), urls.base_parts("source"))
    raw = found.withColumns({"raw_forms": forms.assemble_forms("parts"), "base": base})
    with_form = f"""transform(raw_forms, f -> struct({extracted.form_action_sql('f.action', 'base')} AS action,
        f.method AS method, f.inputs AS inputs, {forms.has_csrf_field_sql('f.inputs')} AS csrf_protected))"""
    issues = forms.form_issues_sql("f.method", "f.inputs", "f.csrf_protected")
    flagged = f"""transform(forms, f -> struct(f.action AS action, f.method AS method, f.inputs AS inputs,
        f.csrf_protected AS csrf_protected, {issues} AS issues))"""
    return raw.withColumn("forms", F.expr(with_form)).withColumn("forms", F.expr(flagged))


def page_findings(pages: DataFrame, key: str | None = "page_id") -> DataFrame:
    """Findings of pages with ``url`` and ``html``; ``key`` names a column that tells captures apart.

    Rows are made of a page before Python sees any: the function that assembles forms gets rows without html.
    """
    sections = ", ".join(f"coalesce({s}, array())" for s in _page_sections())
    every = f"concat(array({_finding('internal_urls', 'url', parts=_NO_PARTS)}), {sections})"
    found = _with_forms(_prepared(pages, key).select("page_key", F.inline(F.expr(every))))
    of_forms = ", ".join(f"coalesce({s}, array())" for s in _form_sections())
    names = [c for c in COLUMNS if c != "page_key"]
    itself = "array(struct(" + ", ".join(names) + "))"
    rows = F.inline(F.expr(f"IF(parts IS NULL, {itself}, concat({of_forms}))"))
    return found.select("page_key", rows).select(*COLUMNS)


def asset_findings(js_urls: DataFrame, js_assets: DataFrame) -> DataFrame:
    """Endpoints and secrets of the captured scripts that the pages refer to.

    Each distinct body is searched once, under its digest; its findings then go to every URL that serves it.
    """
    scripts = assets.script_dictionary(js_urls, js_assets)
    endpoints = f"""transform({texts.endpoints_sql('body')}, (e, i) -> {_finding(
        'js_endpoint_findings', 'e.value', 'i', 'source', 'e.category')})"""
    secrets = f"transform({texts.secrets_sql('body')}, (h, i) -> {_secret('h', 'source', 'i')})"
    search = lambda bodies: bodies.select(
        F.lit(None).cast("bigint").alias("page_key"), F.inline(F.expr(f"concat({endpoints}, {secrets})"))
    )
    return assets.searched(scripts, search).select(*COLUMNS)


def corpus_findings(
    pages: DataFrame,
    js_assets: DataFrame | None = None,
    exposed: DataFrame | None = None,
    errors: DataFrame | None = None,
    key: str | None = "page_id",
    store: bool = False,
) -> DataFrame:
    """The complete findings table.

    ``store`` writes the page findings once, split by section, so that several reports read that small table
    instead of searching all html again. Script assets always need it: the page findings feed the result and
    the join with the script URLs.
    """
    found = page_findings(pages, key)
    if store or js_assets is not None:
        found = written(found, "page-findings", partition_by="section").select(*COLUMNS)
    if js_assets is not None:
        js_urls = found.filter(F.col("section") == "js_files").select(F.col("value").alias("js_url"))
        found = found.unionByName(asset_findings(js_urls, js_assets))
    for section, rows, category, value in (
        ("interesting_files", exposed, "content_length", "url"),
        ("errors", errors, "error", "url"),
    ):
        if rows is not None:
            extra = rows.select(
                F.lit(section).alias("section"), F.col(category).alias("category"), F.col(value).alias("value")
            )
            found = found.unionByName(
                extra.withColumns({"source": F.col("value"), "pos": F.lit(0)}), allowMissingColumns=True
            )
    return found


def distinct_findings(findings: DataFrame) -> DataFrame:
    """``section, category, value, n``: every value of the set sections once, with how often it was seen.

    One shuffle, after partial aggregation.
    """
    in_sets = findings.filter(F.col("section").isin(*SET_SECTIONS))
    return in_sets.groupBy("section", "category", "value").agg(F.count(F.lit(1)).alias("n"))


_STORE_SCHEMA = "section string, category string, value string, n bigint, run string, part int"


def merge_findings(findings: DataFrame, table: str, folder: str, run: str, parts: int = 64) -> DataFrame:
    """Merge the set sections of one capture run into the stored set ``table``; returns ``section, category, value, n``
    of all runs merged so far, equal to ``distinct_findings`` over the union of their findings.

    The store is partitioned by ``part``, a hash of the value into ``parts``: a run reduces its findings to distinct
    values with counts (partial aggregation before the shuffle), and only the partitions its values fall in are read,
    summed with it and written again (dynamic overwrite); the others are not touched. The merged partitions are first
    written whole under the shared checkpoint folder, so the overwrite reads a finished table, never the one it replaces.
    Every rewritten partition holds a marker row of ``run`` (``section`` null): a run merged again, after a failure or
    by mistake, adds nothing to partitions that have its marker, and so is counted once. ``folder`` holds the store,
    on storage all executors share; ``table`` names it in the catalog. Findings of an empty run leave the store as it is.
    """
    spark = findings.sparkSession
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], _STORE_SCHEMA)
        empty.write.partitionBy("part").option("path", f"{folder}/findings").saveAsTable(table)
    stored = spark.table(table)
    part = F.pmod(F.xxhash64("section", "category", "value"), F.lit(parts)).cast("int")
    counted = distinct_findings(findings).select("section", "category", "value", "n", F.lit(None).cast("string").alias("run"), part.alias("part"))
    # At most ``parts`` rows each: the partitions this run was merged into before, and those it touches now.
    done = stored.where(F.col("run") == run).select("part").distinct()
    fresh = counted.join(F.broadcast(done), "part", "left_anti")
    touched = fresh.select("part").distinct()
    old = stored.join(F.broadcast(touched), "part", "left_semi")
    summed = (
        old.where(F.col("run").isNull()).unionByName(fresh)
        .groupBy("section", "category", "value", "part").agg(F.sum("n").alias("n"))
        .select("section", "category", "value", "n", F.lit(None).cast("string").alias("run"), "part")
    )
    markers = old.where(F.col("run").isNotNull()).unionByName(
        touched.select(*[F.lit(None).cast("string").alias(c) for c in ("section", "category", "value")],
                       F.lit(None).cast("bigint").alias("n"), F.lit(run).alias("run"), "part")
    ).dropDuplicates(["run", "part"])
    staged = written(summed.unionByName(markers), "findings-merge")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        staged.select(*[c.split()[0] for c in _STORE_SCHEMA.split(", ")]).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    return spark.table(table).where(F.col("run").isNull()).select("section", "category", "value", "n")


def endpoints_merged(findings: DataFrame) -> DataFrame:
    """``category, n_values``: size of each merged endpoint set."""
    merged = distinct_findings(findings.filter(F.col("section") == "js_endpoint_findings"))
    return merged.groupBy("category").agg(F.count(F.lit(1)).alias("n_values"))


def section_totals(findings: DataFrame) -> DataFrame:
    """``section, category, n, n_idor, n_admin``: sizes of all sections, sets counted by distinct value.

    Bag rows carry no value into the aggregation, so each bag is one group that shrinks before the shuffle.
    """
    value = F.when(F.col("section").isin(*SET_SECTIONS), F.col("value"))
    by_category = F.col("section").isin("js_endpoint_findings")
    category = F.when(by_category, F.col("category")).otherwise("")
    once = findings.groupBy("section", category.alias("category"), value.alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    is_param = F.col("section") == "params"
    return once.groupBy("section", "category").agg(
        F.sum(F.when(F.col("section").isin(*SET_SECTIONS), 1).otherwise(F.col("rows"))).alias("n"),
        F.sum(F.when(is_param & texts.is_idor_name(F.col("value")), 1).otherwise(0)).alias("n_idor"),
        F.sum(F.when(is_param & texts.is_admin_name(F.col("value")), 1).otherwise(0)).alias("n_admin"),
    )


def findings_doc(findings: DataFrame) -> DataFrame:
    """``section, n``: the sections of the consolidated document with their sizes."""
    totals = section_totals(findings)
    name = F.when(
        F.col("category") != "", F.concat_ws(".", "section", "category")
    ).otherwise(F.col("section"))
    plain = totals.select(name.alias("section"), "n")
    params = totals.filter(F.col("section") == "params").select(
        F.inline(
            F.array(
                F.struct(F.lit("idor_candidates").alias("section"), F.col("n_idor").alias("n")),
                F.struct(F.lit("admin_param_candidates").alias("section"), F.col("n_admin").alias("n")),
            )
        )
    )
    return plain.unionByName(params)


def summary_counts(findings: DataFrame, files_checked: bool = False) -> DataFrame:
    """``metric, value``: the counters of a run; zero for what was not found."""
    totals = section_totals(findings)

    def total(section: str, column: str = "n", category: str = "") -> F.Column:
        chosen = (F.col("section") == section) & (F.col("category") == category)
        return F.coalesce(F.sum(F.when(chosen, F.col(column))), F.lit(0)).cast("bigint")

    counters = {
        "internal_urls": total("internal_urls"),
        "js_files": total("js_files"),
        "api_paths": total("js_endpoint_findings", category="api_paths"),
        "full_urls": total("js_endpoint_findings", category="full_urls"),
        "forms": total("forms"),
        "risky_forms": total("form_risk_flags"),
        "emails": total("emails"),
        "params": total("params"),
        "idor_candidates": total("params", "n_idor"),
        "secrets": total("secrets"),
    }
    if files_checked:
        counters["interesting_files"] = total("interesting_files")
    row = totals.agg(*[column.alias(name) for name, column in counters.items()])
    pairs = [F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in counters]
    return row.select(F.inline(F.array(*pairs)))
