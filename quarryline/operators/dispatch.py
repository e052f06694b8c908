"""Routing of pages to site profiles by host; what can't be routed is a row of its own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without user and port, null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)
    return F.when(found != "", F.lower(found))


def domain_label(name: Column) -> Column:
    """The label before the last `com`; before a leading `com`, the last label of the host."""
    labels = F.split(name, r"\.")
    at = F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.get(labels, i) == "com")
    last = F.get(at, F.size(at) - 1)
    return F.get(labels, F.pmod(last - 1, F.size(labels)))


def registry(df: DataFrame, sites: Iterable[str]) -> DataFrame:
    """A table of site labels: a fixed handful, which may be broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame([(s,) for s in sites], "site string"))


def with_route(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", host(F.col("url"))).withColumn("site", domain_label(F.col("host")))


def supported(pages: DataFrame, sites: Iterable[str]) -> DataFrame:
    """Pages of known sites, with host and site."""
    return with_route(pages).join(registry(pages, sites), "site", "left_semi")


def rejected(pages: DataFrame, sites: Iterable[str]) -> DataFrame:
    """page_id, url, host, reason of all other pages."""
    reason = F.when(F.col("host").isNull(), "no_host").when(F.col("site").isNull(), "no_site").otherwise(F.concat(F.lit("Cannot import product data from "), "host"))
    return with_route(pages).join(registry(pages, sites), "site", "left_anti").select("page_id", "url", "host", reason.alias("reason"))
