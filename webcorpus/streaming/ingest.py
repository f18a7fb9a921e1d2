"""Captured pages as a stream: incremental findings and the set of URLs already seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.operators import crawl, extract
from webcorpus.plans.findings import page_findings


def page_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Stream of captured pages from a folder or pattern that parquet files keep arriving in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_findings(pages: DataFrame, key: str | None = "page_id") -> DataFrame:
    """Findings of a page stream. Extraction is local to a page, so no state is kept."""
    return page_findings(pages, key)


def visited_urls(links: DataFrame) -> DataFrame:
    """Each URL once, at its first sighting: the visited set as streaming state, exact and never forgotten.

    State is one key per URL, dealt by its hash; on a cluster keep it in RocksDB (``session.STREAM_SETTINGS``), so that it
    lies on disk and not in the heap. Links of one micro-batch are made distinct before the shuffle.
    """
    return links.select("url").dropDuplicates(["url"])


def visited_in_batches(links: DataFrame, table: str, folder: str, buckets: int = 64) -> DataFrame:
    """The visited set in two levels: each micro-batch first makes its URLs distinct (a partial aggregate in every input task, so
    a URL that every page links to leaves each task once), then keeps those not yet in ``table`` and adds them.

    ``table`` is bucketed by URL into ``buckets`` and partitioned by micro-batch; the batch's distinct URLs are dealt by the same
    hash, so the anti join reads the stored set bucket by bucket without an exchange on its side. A micro-batch that runs again
    after a failure overwrites its own partition and ignores it in the comparison: nothing is written twice. Progress and the
    stored set lie in ``folder``, on storage all executors share; ``table`` names it in the catalog. Returns ``url, batch``.
    """
    spark = links.sparkSession
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], "url string, batch long")
        empty.write.partitionBy("batch").bucketBy(buckets, "url").sortBy("url").option("path", f"{folder}/visited").saveAsTable(table)

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = unseen(batch, table, batch_id, buckets)
        mode = session.conf.get("spark.sql.sources.partitionOverwriteMode")
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            new.write.insertInto(table, overwrite=True)
        finally:
            session.conf.set("spark.sql.sources.partitionOverwriteMode", mode)

    query = links.select("url").writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.table(table)


def unseen(batch: DataFrame, table: str, batch_id: int, buckets: int) -> DataFrame:
    """``url, batch``: distinct URLs of ``batch`` that ``table`` holds from no other micro-batch, dealt like its buckets."""
    fresh = batch.where(F.col("url").isNotNull()).select("url").distinct().repartition(buckets, "url")
    known = batch.sparkSession.table(table).where(F.col("batch") != batch_id).select("url")
    return fresh.join(known, "url", "left_anti").select("url", F.lit(batch_id).cast("bigint").alias("batch"))


def first_visits(links: DataFrame, event_time: str, delay: str = "1 day", spread_by: str | None = None) -> DataFrame:
    """First sighting of each URL within a time, for streams whose event time can be trusted; else ``visited_urls``.

    Rows that arrive behind the watermark are dropped: this form is not for sources that replay old captures. State is bounded: a URL is forgotten once the watermark has passed its sighting by ``delay``, so it may
    show up again much later. With ``spread_by`` (a column such as the linking page) sightings are first
    thinned out in 32 slices per URL, so a URL that most pages link to does not meet one task.
    """
    links = links.withWatermark(event_time, delay)
    if spread_by is not None:
        slices = links.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(32)))
        links = slices.dropDuplicatesWithinWatermark(["url", "_slice"]).drop("_slice")
    return links.dropDuplicatesWithinWatermark(["url"])


def linked_urls(pages: DataFrame, event_time: str | None = None) -> DataFrame:
    """``page_url, url`` of all links of a page stream, and its event time if it has one."""
    return extract.page_links(pages, keep=() if event_time is None else (event_time,))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process what has arrived, append it to the table in ``folder`` and return that table.

    Table and progress lie in ``folder``, which the caller names and keeps on storage all executors share: run again with
    the same folder, the stream goes on where the last run stopped, and rows that were written aren't written again.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def crawl_frontier(edges: DataFrame, start: DataFrame, folder: str, max_depth: int = 3) -> DataFrame:
    """Crawl depths kept up to date as a stream of edges ``src, dst`` arrives: after each micro-batch the stored ``url, depth``
    equal ``crawl_depth`` over all edges so far, a depth lowered where a shorter path appears (``crawl.frontier_merge``).

    Logs and progress lie in ``folder``, on storage all executors share: run again with the same folder, the stream goes on where
    it stopped, and a replayed micro-batch replaces what it wrote. Returns the depths as they stand.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        crawl.frontier_merge(batch, start, folder, batch_id, max_depth)

    query = edges.select("src", "dst").writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    return crawl.frontier_depths(edges.sparkSession, folder)
