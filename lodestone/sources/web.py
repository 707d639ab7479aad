"""Web sources: which addresses may be fetched, and pages as rows."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.python import html_to_markdown


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1), r"\.+$", ""))


def allowed(url: Column) -> Column:
    """http(s) with a host, no credentials, not this machine and not a private name."""
    name = host(url)
    return url.rlike("^https?://") & (name != "") & ~url.rlike("^[a-z]+://[^/]*@") & (name != "localhost") & ~name.rlike(r"\.(local|internal)$")


@F.pandas_udf(BooleanType())
def public_address(hosts: pd.Series) -> pd.Series:
    """False for IP literals that are not globally routable; names pass."""

    def one(h: str) -> bool:
        try:
            return ipaddress.ip_address(h.strip("[]")).is_global
        except ValueError:
            return True

    return hosts.map(one)


def pages(fetched: DataFrame) -> DataFrame:
    """url, title, markdown and content_hash of fetched pages (url, html) whose address is allowed."""
    safe = fetched.where(allowed(F.col("url")) & public_address(host(F.col("url"))))
    return safe.select("url", html_to_markdown("html").alias("p")).select("url", "p.title", F.col("p.markdown").alias("text"), F.sha2("p.markdown", 256).alias("content_hash"))


def fetch(spark: SparkSession, urls: DataFrame, get: Callable[[str], str | None]) -> DataFrame:
    """url and html of urls, by a function that executors can call."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "html": [get(u) for u in b["url"]]})

    return urls.select("url").mapInPandas(run, "url string, html string")


def search_results(results: DataFrame) -> DataFrame:
    """Results of a search provider (query_id, position, url, title, snippet) as hits: score is one over the rank among those kept."""
    from ..operators.common import rank

    kept = results.where((F.length(F.trim("snippet")) > 0) & allowed(F.col("url")))
    return kept.withColumn("rank", rank("query_id", order=[F.asc("position")])).withColumn("score", 1 / F.col("rank"))
