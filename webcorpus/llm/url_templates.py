"""URL filter by a path-template tree per host.

Paths become templates from the root down: a segment whose values vary under its parent is a wildcard, other segments stay
as branches. Branches of a parent whose labelled shares of good pages don't differ by more than chance are merged into one: ordered
by share, they are cut where two neighbours differ.
A template's purity is its share of good pages, smoothed towards its host's, and that towards the share of all; a template of
low purity is rejected. Rules given by host and path go before. Everything is DataFrame operations: the tree is built from one
row per host and typed path with counts, not from pages.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.operators.joins import broadcast_if_small
from webcorpus.session import written

DEPTH = 6  # levels of the tree; what lies below a deeper segment is one wildcard
VALUES, SPREAD = 12, 0.2  # a segment varies if a parent has so many values of it and so many a page
DIFFERS = 2.58  # standard errors by which branches differ (1 % of equal ones)
HOST_WEIGHT, TEMPLATE_WEIGHT = 20.0, 10.0  # labelled pages that the smoothing counts for
LEAST_PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies after the first ``://`` up to ``/ ? #``, in lower case, and up to ``? #`` from there; else empty."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``rule, verdict`` of the longest rule that fits a URL, else null."""
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.name)).alias("size"), F.lit(len(r.host)).alias("host"), F.lit(r.name).alias("rule"),
                     F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def typed_path(path: Column) -> Column:
    """A path's segments with what varies by its form named by it: numbers, hexadecimal, dates, long mixed names."""
    text = F.regexp_replace(path, "/+", "/")
    text = F.regexp_replace(text, "(?<=/)[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[/.]|$)", "{date}")
    text = F.regexp_replace(text, "(?<=/)[0-9]+(?=[/.]|$)", "{number}")
    text = F.regexp_replace(text, "(?<=/)(?=[0-9a-f-]*[0-9])[0-9a-f-]{12,}(?=[/.]|$)", "{hex}")
    return F.regexp_replace(text, "(?<=/)(?=[^/]*[0-9])[^/.{}]{20,}(?=[/.]|$)", "{name}")


def template_tree(counts: DataFrame) -> DataFrame:
    """``host, typed, template`` of ``counts(host, typed, pages, good, labelled)``.

    One level after the other: first what varies is widened, by numbers of values and pages of the parent; then siblings with
    equal rest are compared in order of their shares, and neighbours that don't differ become one branch.
    """
    segments = F.split(F.regexp_replace("typed", "^/", ""), "/")
    tree = counts.withColumn("_s", segments).withColumn("_at", F.lit(""))
    deepest = tree.agg(F.max(F.size("_s")).alias("n")).first().n or 0
    for level in range(min(DEPTH, deepest)):
        here = F.get("_s", F.lit(level))
        tree = tree.withColumn("_v", here)
        values = tree.where("_v IS NOT NULL").groupBy("host", "_at", "_v").agg(F.sum("pages").alias("n"))
        spread = values.groupBy("host", "_at").agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_pages"))
        varies = (F.col("_values") >= VALUES) & (F.col("_values") >= SPREAD * F.col("_pages"))
        wide = spread.where(varies).select("host", "_at", F.lit(True).alias("_wide"))
        tree = tree.join(broadcast_if_small(wide), ["host", "_at"], "left")
        step = F.when(F.col("_v").isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("_wide"), "*").otherwise(F.col("_v"))))
        tree = tree.withColumn("_at", F.concat("_at", step)).drop("_wide", "_v")
        tree = written(tree, "url-tree")
    deep = F.when(F.size("_s") > DEPTH, F.lit("/**")).otherwise("")
    tree = tree.withColumn("template", F.concat("_at", deep)).drop("_at", "_s")
    # Siblings: the first plain segment is the branch, the rest is what they have in common.
    branch = F.regexp_extract("template", "^/([^/*{}]+)(?=/)", 1)
    tree = tree.withColumn("_branch", branch).withColumn(
        "_family", F.when(branch != "", F.concat(F.lit("/*"), F.substring("template", F.length(branch) + 2, F.length("template"))))
    )
    own = tree.where("_family IS NOT NULL").groupBy("host", "_family", "_branch").agg(
        F.sum("good").alias("g"), F.sum("labelled").alias("n")
    )
    # In order of their shares, siblings are cut apart where two neighbours differ by more than chance.
    siblings = Window.partitionBy("host", "_family")
    whole = (F.sum("g").over(siblings) + 1) / (F.sum("n").over(siblings) + 2)
    own = own.withColumn("share", (F.col("g") + whole) / (F.col("n") + 1))
    order = siblings.orderBy("share", "_branch")
    g, n, last_g, last_n = F.col("g"), F.nullif("n", F.lit(0)), F.lag("g").over(order), F.nullif(F.lag("n").over(order), F.lit(0))
    both = (g + last_g + 1) / (n + last_n + 2)
    gap = F.abs(g / n - last_g / last_n) / F.sqrt(both * (1 - both) * (1 / n + 1 / last_n))
    own = own.withColumn("cut", F.coalesce(gap > DIFFERS, F.lit(False)).cast("int"))
    own = own.withColumn("group", F.sum("cut").over(order)).withColumn(
        "branches", F.count(F.lit(1)).over(Window.partitionBy("host", "_family", "group"))
    )
    merged = F.concat(F.lit("/*"), F.when(F.col("group") > 0, F.col("group").cast("string")).otherwise(""))
    alike = own.where("branches > 1").select("host", "_family", "_branch", merged.alias("_merged"))
    tree = tree.join(broadcast_if_small(alike), ["host", "_family", "_branch"], "left")
    joined = F.concat("_merged", F.substring("_family", 3, F.length("_family")))
    return tree.withColumn("template", F.coalesce(joined, F.col("template"))).drop("_merged", "_family", "_branch")


def url_filter(
    pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` per row of ``pages``.

    ``labelled(url, label)`` holds judged URLs, label 1 for good; null labels count for nothing, and without any every template
    has purity one half and is allowed. A null URL or one without ``://`` has an empty host and path and is judged as such.
    Repeated rows stay rows, and count as often. Other columns aren't read. An empty table gives an empty result.
    """
    host, path = host_and_path(pages[url])
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("typed", typed_path(F.col("path")))
    host, path = host_and_path(labelled["url"])
    judged = labelled.where(F.col("label").isNotNull()).select(host.alias("host"), typed_path(path).alias("typed"), "label")
    counts = rows.groupBy("host", "typed").agg(F.count(F.lit(1)).alias("pages"), F.lit(0).alias("good"), F.lit(0).alias("labelled"))
    known = judged.groupBy("host", "typed").agg(F.lit(0).alias("pages"), F.sum("label").alias("good"), F.count(F.lit(1)).alias("labelled"))
    counts = counts.unionByName(known).groupBy("host", "typed").agg(*[F.sum(c).alias(c) for c in ("pages", "good", "labelled")])
    tree = template_tree(written(counts, "url-counts"))
    hosts = tree.groupBy("host").agg(F.sum("good").alias("g"), F.sum("labelled").alias("n"))
    total = tree.agg(F.sum("good").alias("g"), F.sum("labelled").alias("n")).first()
    prior = (total.g or 0) / total.n if total.n else 0.5
    hosts = hosts.select("host", ((F.col("g") + HOST_WEIGHT * prior) / (F.col("n") + HOST_WEIGHT)).alias("_host"))
    kinds = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("labelled").alias("n"))
    kinds = kinds.join(hosts, "host").select(
        "host", "template",
        ((F.col("g") + TEMPLATE_WEIGHT * F.col("_host")) / (F.col("n") + TEMPLATE_WEIGHT)).alias("purity"),
    )
    found = written(tree.select("host", "typed", "template").join(kinds, ["host", "template"]), "url-templates")
    met = rows.join(broadcast_if_small(found), ["host", "typed"])
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return met.withColumn("_rule", rule).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")).alias("verdict"),
        "template", "purity",
    )
