"""Which URLs may be followed: target check, allowed domains, static assets, already visited."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.functions import urls
from webcorpus.functions.text_sql import let
from webcorpus.operators.joins import is_small
from webcorpus.session import written


def valid_targets(targets: DataFrame, url: str = "url") -> DataFrame:
    """Targets with an http or https scheme."""
    return targets.filter(urls.has_web_scheme(F.col(url)))


def rejected_targets(targets: DataFrame, url: str = "url") -> DataFrame:
    """The other targets, in the shape of the error table."""
    return targets.filter(~urls.has_web_scheme(F.col(url))).select(
        F.col(url).alias("url"), F.lit("not a web address: scheme is not http or https").alias("error")
    )


def allowed_domains(
    spark: SparkSession, target: str, include_subdomains: bool = False, extra: Iterable[str] = ()
) -> DataFrame:
    """Scope table of one target: its host, on request its root domain, and further domains."""
    domains = [urls.domain(F.lit(target))]
    if include_subdomains:
        domains.append(urls.root_domain(F.lit(target)))
    domains += [F.lit(name) for name in extra]
    return spark.range(1).select(F.explode(F.array_distinct(F.array(*domains))).alias("domain"))


def host_suffixes(host: str) -> Column:
    """``a.b.c`` in column ``host`` -> ``[a.b.c, b.c, c]``."""
    tails = "transform(l, (_, i) -> array_join(slice(l, i + 1, size(l)), '.'))"
    return F.expr(let(f"split({host}, '[.]')", "l", tails))


def widest_domains(scope: DataFrame) -> DataFrame:
    """Scope without domains that another one already covers.

    Then a host has at most one matching suffix, and joining on the suffix neither loses nor repeats rows.
    """
    scope = scope.filter(F.col("domain") != "").select("domain").distinct()
    inner = scope.select(
        F.col("domain").alias("covered"), F.explode(host_suffixes("domain")).alias("domain")
    ).filter(F.col("domain") != F.col("covered"))
    covered = inner.join(scope, "domain", "left_semi").select(F.col("covered").alias("domain")).distinct()
    return scope.join(covered, "domain", "left_anti")


def in_scope(links: DataFrame, scope: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is an allowed domain or lies below one; an equi-join on the host's dot suffixes.

    A small scope is broadcast and the links stay where they are. A scope past the size bound is matched
    against the distinct hosts first, so that the links are shuffled once and hot hosts count once.
    """
    small = is_small(scope)  # pruning only makes it smaller
    domains = widest_domains(scope) if small else written(widest_domains(scope), "scope")
    hosted = links.withColumn("_host", urls.domain(F.col(url)))
    if small:
        matching = hosted.withColumn("_suffix", F.explode(host_suffixes("_host")))
        return matching.join(
            F.broadcast(domains), F.col("_suffix") == F.col("domain"), "left_semi"
        ).drop("_suffix", "_host")
    hosts = hosted.select("_host").distinct().withColumn("_suffix", F.explode(host_suffixes("_host")))
    allowed = hosts.join(domains, F.col("_suffix") == F.col("domain"), "left_semi").select("_host")
    return hosted.join(allowed, "_host", "left_semi").drop("_host")


def without_static_assets(links: DataFrame, url: str = "url") -> DataFrame:
    return links.filter(~urls.is_static_asset(F.col(url)))


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links whose URL is not among the visited ones."""
    return links.join(visited.select("url").distinct(), "url", "left_anti")
