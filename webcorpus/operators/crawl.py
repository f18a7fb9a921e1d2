"""Bounded breadth-first traversal of the captured link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.operators import extract, robots, scope
from webcorpus.operators.joins import measure
from webcorpus.plans.report import numbered
from webcorpus.session import new_folder, written


def crawl_edges(
    pages: DataFrame,
    allowed: DataFrame,
    robots_files: DataFrame | None = None,
    user_agent: str = robots.USER_AGENT,
    known_links: DataFrame | None = None,
) -> DataFrame:
    """``src, dst``: links a crawl would follow from captured pages, and those of ``known_links(page_url, url)``.

    Filters run cheapest first. Pages that robots rules block stay reachable but lead nowhere: each source page is judged
    once, and the html is never shuffled. Sources have no fragment.
    """
    links = extract.page_links(pages).select("page_url", "url")
    if known_links is not None:
        links = links.unionByName(known_links.select("page_url", "url"))
    links = scope.in_scope(scope.without_static_assets(links), allowed)
    edges = links.select(F.regexp_extract("page_url", "^[^#]*", 0).alias("src"), F.col("url").alias("dst"))
    if robots_files is None:
        return edges
    edges = written(edges.distinct(), "links")  # searched once, for the sources and for the join
    judged = robots.robots_allowed(edges.select("src").distinct(), robots_files, user_agent, url="src")
    return edges.join(judged.filter("allowed").select("src"), "src", "left_semi")


def bucketed_edges(edges: DataFrame, buckets: int) -> DataFrame:
    """Distinct ``src, dst`` saved once as a table of ``buckets`` buckets by ``src``, sorted, under the shared folder.

    A join on ``src`` with it moves only its other side, at every level of a walk. Copies of an edge are dropped before the
    shuffle (partial aggregation); the rows are then dealt by ``src`` so that each bucket is one file of one task.
    A source with very many edges makes one large bucket: it is read as a sorted run by one task, not split.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "edges")
    name = "edges_" + folder.rsplit("-", 1)[-1]
    pairs = edges.select("src", "dst").distinct().repartition(buckets, "src")
    pairs.write.bucketBy(buckets, "src").sortBy("src").option("path", folder).saveAsTable(name)
    return spark.table(name)


def crawl_depth(
    edges: DataFrame, start: DataFrame, max_depth: int = 3, enough: int | None = None, buckets: int | None = None
) -> DataFrame:
    """``url, depth`` of every URL within ``max_depth`` steps, depth being the shortest distance.

    With ``enough`` the walk ends after the level that brings the total to that many URLs. With ``buckets`` the edges are
    written once bucketed by ``src`` (``bucketed_edges``; at least ``spark.sql.shuffle.partitions`` buckets, so that the
    planner keeps them): a level past the broadcast bound then shuffles its frontier only, never the edges.

    The distinct edges are written once, so that no level extracts links again. While the frontier is small
    it is broadcast and the edges are only scanned; past the bound both sides shuffle and AQE splits a source
    that holds very many edges. ``distinct`` before the anti join shrinks hub targets on the map side. Each
    level is written: the plan stays flat and a lost executor never replays the levels before it.
    """
    if buckets is None:
        edges = written(edges.select("src", "dst").distinct(), "edges")
    else:
        edges = bucketed_edges(edges, buckets)
    total = 0
    visited = frontier = written(start.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, max_depth + 1):
        sources = frontier.select(F.col("url").alias("src"))
        size = measure(sources)
        total += size.rows
        if size.rows == 0 or (enough is not None and total >= enough):
            break
        sources = F.broadcast(sources) if size.small else sources
        reached = edges.join(sources, "src").select(F.col("dst").alias("url")).distinct()
        new = reached.join(visited.select("url"), "url", "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)), "frontier")
        visited = visited.unionByName(frontier)
    return visited


def crawl_capped(edges: DataFrame, start: DataFrame, max_depth: int = 3, max_pages: int = 300) -> DataFrame:
    """The first ``max_pages`` URLs in ``(depth, url)`` order: a crawl with a page cap.

    Whole levels are walked until they hold enough URLs; deeper ones could not be among the first. The cut is found from the
    counts of the levels (one row each): levels before it are kept whole, and of the cutting level only the first URLs in URL
    order, numbered exactly by range partitions. No sort of all visited URLs, no top-k in one task, whatever the cap.
    """
    visited = written(crawl_depth(edges, start, max_depth, enough=max_pages), "visited")
    before, cut, room = 0, None, 0
    for depth, n in sorted(tuple(r) for r in visited.groupBy("depth").count().collect()):
        if before + n > max_pages:
            cut, room = depth, max_pages - before
            break
        before += n
    if cut is None:
        kept = visited
    elif room == 0:
        kept = visited.where(F.col("depth") < cut)
    else:
        part = numbered(visited.where(F.col("depth") == cut), "depth", ["url"]).where(F.col("pos") < room).drop("pos")
        kept = visited.where(F.col("depth") < cut).unionByName(part)
    # In (depth, url) order: a range sort over the kept rows, not a top-k in one task.
    return kept.orderBy("depth", "url")


EDGE_LOG = "src string, dst string, batch bigint"
DEPTH_LOG = "url string, depth int, batch bigint"


def frontier_merge(new_edges: DataFrame, start: DataFrame, folder: str, batch: int, max_depth: int = 3) -> None:
    """Bring the depths stored in ``folder`` up to date with one batch of edges ``src, dst``; see ``frontier_depths``.

    ``folder/edges`` keeps every edge and ``folder/depths`` a row each time a URL's depth falls, both partitioned by batch. The
    batch's edges are added first. Depths then fall where they give a shorter path from ``start``: by the new edges out of URLs
    already reached (and the starts, at 0, the first time), then level by level out of every URL that fell, over all edges, until
    none falls. A candidate of a level is one deeper than its source, so at most ``max_depth + 1`` levels run; each is written,
    and a small level is broadcast against the edges. Edges with a null end are left out. A batch that runs again after a failure
    reads neither of its own partitions and replaces both: nothing counts twice.
    """
    spark = new_edges.sparkSession
    dynamic = {"partitionOverwriteMode": "dynamic"}
    edge_path, depth_path = f"{folder}/edges", f"{folder}/depths"
    if not _exists(spark, depth_path):
        spark.createDataFrame([], DEPTH_LOG).write.mode("append").partitionBy("batch").parquet(depth_path)
    pairs = new_edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    tagged = pairs.withColumn("batch", F.lit(batch).cast("bigint"))
    tagged.write.mode("overwrite").options(**dynamic).partitionBy("batch").parquet(edge_path)
    edges = spark.read.schema(EDGE_LOG).parquet(edge_path).select("src", "dst")
    mine = spark.read.schema(EDGE_LOG).parquet(edge_path).where(F.col("batch") == batch).select("src", "dst")
    log = spark.read.schema(DEPTH_LOG).parquet(depth_path).where(F.col("batch") != batch)
    known = written(log.groupBy("url").agg(F.min("depth").alias("depth")), "frontier-known")
    seeds = start.where(F.col("url").isNotNull()).select("url", F.lit(0).alias("depth"))
    candidates = seeds.unionByName(_deeper(mine, known, max_depth))
    lowered = None
    for _ in range(max_depth + 2):
        fallen = written(_falls(candidates, known, lowered), "frontier-fallen")
        if fallen.isEmpty():
            break
        lowered = fallen if lowered is None else lowered.unionByName(fallen)
        candidates = _deeper(edges, fallen, max_depth)
    if lowered is not None:
        least = lowered.groupBy("url").agg(F.min("depth").alias("depth")).withColumn("batch", F.lit(batch).cast("bigint"))
        least.write.mode("overwrite").options(**dynamic).partitionBy("batch").parquet(depth_path)


def frontier_depths(spark, folder: str) -> DataFrame:
    """``url, depth`` as stored in ``folder`` by ``frontier_merge``: after each batch equal to ``crawl_depth`` over all edges and
    the same starts. Before the first batch, empty."""
    if not _exists(spark, f"{folder}/depths"):
        return spark.createDataFrame([], "url string, depth int")
    log = spark.read.schema(DEPTH_LOG).parquet(f"{folder}/depths")
    return log.groupBy("url").agg(F.min("depth").alias("depth"))


def _deeper(edges: DataFrame, reached: DataFrame, max_depth: int) -> DataFrame:
    """``url, depth``: the ends of edges out of ``reached(url, depth)``, one deeper, within ``max_depth``."""
    sources = reached.where(F.col("depth") < max_depth).select(F.col("url").alias("src"), "depth")
    sources = F.broadcast(sources) if measure(sources).small else sources
    return edges.join(sources, "src").select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))


def _falls(candidates: DataFrame, known: DataFrame, lowered: DataFrame | None) -> DataFrame:
    """``url, depth`` of candidates below the best depth stored or lowered so far: the least candidate per URL."""
    best = candidates.groupBy("url").agg(F.min("depth").alias("depth"))
    bounds = [known] if lowered is None else [known, lowered.groupBy("url").agg(F.min("depth").alias("depth"))]
    for i, bound in enumerate(bounds):
        best = best.join(bound.select("url", F.col("depth").alias(f"_b{i}")), "url", "left")
    below = [(F.col(f"_b{i}").isNull() | (F.col("depth") < F.col(f"_b{i}"))) for i in range(len(bounds))]
    keep = below[0] if len(below) == 1 else below[0] & below[1]
    return best.where(keep).select("url", "depth")


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
