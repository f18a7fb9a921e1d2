"""Readers of captured tables and the row-level rules that apply to a capture."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.functions.patterns import TEXT_CONTENT_MARKS

PAGE_SCHEMA = "page_id bigint, url string, html string"
CAPTURE_SCHEMA = PAGE_SCHEMA + ", status int, headers map<string,string>, error string, ts timestamp"


def read_pages(spark: SparkSession, path: str, file_format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Captured pages, every status kept. JSON needs a schema, so that nothing is inferred.

    JSON lines under the capture schema go through ``read_captures``: a broken line becomes an error row.
    """
    if file_format == "json" and schema in (None, CAPTURE_SCHEMA):
        return read_captures(spark, path)
    reader = spark.read.format(file_format)
    if schema is None and file_format != "parquet":
        schema = CAPTURE_SCHEMA
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


MALFORMED = "malformed capture"
_RAW = "_raw_line"


def read_captures(spark: SparkSession, path: str, schema: str = CAPTURE_SCHEMA) -> DataFrame:
    """Captures from JSON lines where every line is a capture or an error row: nothing becomes nulls in silence.

    A line that is not JSON, or whose fields don't fit ``schema``, is kept as a capture with ``error`` set to
    ``malformed capture: `` and the start of the line, no html, and the URL written in the line where one can be read
    (else null). So ``fetched`` leaves it out and ``page_errors_latest`` reports it. Blank lines are no records.
    """
    # Parsed from text with the whole schema: the JSON file reader parses only the columns a query keeps, so a
    # field of the wrong type that a query drops would not mark its line. Options keep the optimizer from pruning.
    lines = spark.read.text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
    raw = lines.select(F.from_json("value", f"{schema}, {_RAW} string", options).alias("row")).select("row.*")
    broken = F.col(_RAW).isNotNull()
    named = F.nullif(F.regexp_extract(_RAW, r'"url"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    columns = [c.split()[0] for c in schema.split(", ")]
    fixed = {
        "url": F.when(broken, F.coalesce(F.col("url"), named)).otherwise(F.col("url")),
        "html": F.when(broken, F.lit(None)).otherwise(F.col("html")),
        "error": F.when(broken, F.concat(F.lit(MALFORMED + ": "), F.substring(_RAW, 1, 200))).otherwise(F.col("error")),
    }
    return raw.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in columns])


SPREAD_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal a small scan over the cores: files of one row group can't be split, and pages are dear to search.

    Only scans of at most ``SPREAD_BYTES`` of files are ever moved, whatever the number of cores. Larger ones are read where
    they lie; the number of their splits is set at the read, by ``spark.sql.files.maxPartitionBytes`` and ``minPartitionNum``.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def header(headers: Column, name: str) -> Column:
    """Header value by name in any case, NULL if it is missing."""
    matching = F.filter(F.map_entries(headers), lambda entry: F.lower(entry["key"]) == name)
    return F.try_element_at(matching, F.lit(1))["value"]


def is_textual(content_type: Column) -> Column:
    """Content types kept as text; case-sensitive, and a missing type passes."""
    marks = [F.contains(content_type, F.lit(mark)) for mark in TEXT_CONTENT_MARKS]
    return reduce(or_, marks, content_type == "")


def content_gate(captures: DataFrame) -> DataFrame:
    """Blank the html of captures that are not text; the rows stay."""
    content_type = F.coalesce(header(F.col("headers"), "content-type"), F.lit(""))
    return captures.withColumn("html", F.when(is_textual(content_type), F.col("html")).otherwise(""))


def fetched(captures: DataFrame) -> DataFrame:
    """Captures that did not fail."""
    return captures.filter(F.col("error").isNull())


def page_errors_latest(captures: DataFrame) -> DataFrame:
    """Last error per URL; a maximum, so a hot URL is reduced before the shuffle."""
    failed = captures.filter(F.col("error").isNotNull())
    latest = F.max(F.struct("ts", "error"))
    return failed.groupBy("url").agg(latest.alias("last")).select("url", F.col("last.error").alias("error"))
