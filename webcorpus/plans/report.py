"""Report tables and the JSON sink, from the findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.functions import markup, texts, urls
from webcorpus.operators.joins import broadcast_if_small
from webcorpus.plans.findings import SET_SECTIONS, distinct_findings
from webcorpus.session import written

# --- Fixed values: titles and order of the report sections ----------------------------------------

TITLES = {
    "internal_urls": "Internal URLs",
    "js_files": "JavaScript Files",
    "params": "Parameters",
    "idor_candidates": "IDOR-Candidate Params",
    "admin_param_candidates": "Admin-Related Params",
    "emails": "Emails",
    "js_endpoint_findings": None,  # one section per category, titled after it
    "forms": "Forms",
    "form_risk_flags": "Form Risk Flags",
    "secrets": "Possible Secrets",
    "interesting_files": "Interesting Files",
    "comments": "HTML Comments",
}


def _row_text() -> F.Column:
    """One line of text per finding, the cells of table sections joined by `` | ``."""
    section, value = F.col("section"), F.col("value")
    cells = lambda *columns: F.concat_ws(" | ", *columns)
    return (
        F.when(
            section == "forms",
            cells(
                "form.method",
                value,
                F.size("form.inputs").cast("string"),
                F.when(F.col("form.csrf_protected"), "yes").otherwise("NO"),
            ),
        )
        .when(section == "form_risk_flags", cells(value, F.array_join("issues", ", ")))
        .when(section == "secrets", cells("category", "confidence", value, "source"))
        .when(section == "interesting_files", cells(value, F.lit("200"), "category"))
        .when(section == "comments", F.concat("source", F.lit(": "), value))
        .otherwise(value)
    )


def _title() -> F.Column:
    title = F.initcap(F.replace("category", F.lit("_"), F.lit(" ")))
    for section, text in TITLES.items():
        if text is not None:
            title = F.when(F.col("section") == section, F.lit(text)).otherwise(title)
    return title


def report_items(findings: DataFrame) -> DataFrame:
    """``section, item`` and the order of items: sets by value, bags by source and place in it.

    Reads the findings twice (sets are made distinct, bags are not), so they should be a stored table.
    """
    values = distinct_findings(findings)
    is_param = F.col("section") == "params"
    titles = F.array_compact(
        F.array(
            _title(),
            F.when(is_param & texts.is_idor_name(F.col("value")), TITLES["idor_candidates"]),
            F.when(is_param & texts.is_admin_name(F.col("value")), TITLES["admin_param_candidates"]),
        )
    )
    sets = values.select(
        F.explode(titles).alias("section"),
        F.col("value").alias("item"),
        F.col("value").alias("sort_key"),
        F.lit(None).cast("bigint").alias("page_key"),
        F.lit(0).alias("pos"),
    )
    bags = findings.filter(~F.col("section").isin(*SET_SECTIONS) & F.col("section").isin(*TITLES))
    return sets.unionByName(
        bags.select(
            _title().alias("section"), _row_text().alias("item"), F.col("source").alias("sort_key"), "page_key", "pos"
        )
    )


def numbered(rows: DataFrame, group: str, order: list[str], out: str = "pos") -> DataFrame:
    """Exact position of each row in its group without bringing a group into one task.

    Rows are range-sorted by group and order, so a big group spreads over many partitions, and written with
    their partition and place in it, so both are fixed. A row's position is its place in its partition plus
    what earlier partitions hold of the group; those counts are one row per partition and group they touch.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    laid_out = written(
        ordered.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "numbered"
    )
    counts = laid_out.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # Partitions + groups rows: few for sections, as many as the data has for other groups.
    placed = laid_out.join(broadcast_if_small(offsets), [group, "_part"])
    return placed.withColumn(out, F.col("_before") + F.col("_id") - F.col("_first")).drop(
        "_part", "_id", "_first", "_before"
    )


def report_sections(findings: DataFrame) -> DataFrame:
    """``section, pos, item``: every line of the report, numbered from 0 in each section."""
    rows = report_items(findings).withColumnRenamed("pos", "place")
    return numbered(rows, "section", ["sort_key", "page_key", "place"]).select("section", "pos", "item")


def section_counts(findings: DataFrame) -> DataFrame:
    """``section, n``: the count shown next to each section title; empty sections do not appear."""
    return report_items(findings).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def escaped_sections(sections: DataFrame) -> DataFrame:
    """Section lines with their text made safe for HTML."""
    return sections.withColumn("item", markup.escape_html(F.col("item")))


def document_rows(findings: DataFrame) -> DataFrame:
    """The content of the findings document, one typed row per entry; fields that a section lacks are null.

    Set sections hold every value once, with the two derived from parameter names; bag sections hold every finding. Status
    is 200 for files because nothing else counts as found.
    """
    is_param = F.col("section") == "params"
    names = F.array_compact(
        F.array(
            F.col("section"),
            F.when(is_param & texts.is_idor_name(F.col("value")), "idor_candidates"),
            F.when(is_param & texts.is_admin_name(F.col("value")), "admin_param_candidates"),
        )
    )
    sets = distinct_findings(findings).select(F.explode(names).alias("section"), "category", "value")
    section, value = F.col("section"), F.col("value")
    only = lambda name, column: F.when(section == name, column)
    form = section.isin("forms", "form_risk_flags")
    bags = findings.filter(~section.isin(*SET_SECTIONS)).select(
        "section", "page_key", "pos",
        F.when(form, F.col("source")).alias("found_on"),
        F.when(form, value).alias("action"),
        F.when(form, F.col("form.method")).alias("method"),
        only("forms", F.col("form.inputs")).alias("inputs"),
        only("forms", F.col("form.csrf_protected")).alias("csrf_protected"),
        only("form_risk_flags", F.col("issues")).alias("issues"),
        only("secrets", F.col("category")).alias("type"),
        only("secrets", F.col("confidence")).alias("confidence"),
        only("secrets", value).alias("value_preview"),
        F.when(section.isin("secrets", "comments"), F.col("source")).alias("source"),
        only("comments", value).alias("comment"),
        F.when(section.isin("interesting_files", "errors"), value).alias("url"),
        only("interesting_files", F.lit(200)).alias("status"),
        only("interesting_files", F.col("category")).alias("content_length"),
        only("errors", F.col("category")).alias("error"),
    )
    return sets.unionByName(bags, allowMissingColumns=True)


def report_rows(findings: DataFrame, target: str) -> DataFrame:
    """The document's rows with their envelope: target, its file-name key and the time of generation."""
    rows = document_rows(findings)
    return rows.select(
        F.lit(target).alias("target"),
        urls.capture_key(F.lit(target)).alias("target_key"),
        F.current_timestamp().alias("generated_at"),
        *rows.columns,
    )


def write_json_report(findings: DataFrame, target: str, folder: str, run: str) -> str:
    """Write the report as JSON lines, one folder per target, run and section, sorted within files; returns its path.

    One document per target would hold a whole section in one task; lines keep the same content and order and
    can be written and read in parallel. ``run`` names the run, for instance by its time: writing a run again replaces it, and
    other runs stay.
    """
    rows = report_rows(findings, target)
    key = findings.sparkSession.range(1).select(urls.capture_key(F.lit(target)).alias("key")).first().key
    path = f"{folder}/target_key={key}/run={run}"
    order = ("section", "category", "value", "source", "found_on", "url", "page_key", "pos")
    ordered = rows.drop("target_key").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").partitionBy("section").json(path)
    return path
