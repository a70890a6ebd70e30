"""Link graphs of pages: extraction, filters, one hop and breadth-first reach."""

from __future__ import annotations

import itertools
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import slug
from siftwell.session import ship, written


def link_edges(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, href) of every link."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))).alias("position", "href"))
    return found


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """An href against its page's url; null where it cannot be resolved."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


def internal_links(pages: DataFrame, domain: str | None = None) -> DataFrame:
    """(page_id, target, file): a row for each different link of a page that stays on its domain.

    Mail, telephone and fragment links, PDFs and the two home pages (root and /en) are left out.
    """
    ship(pages.sparkSession)
    h = F.col("href")
    links = link_edges(pages).where(~(h.startswith("mailto:") | h.startswith("tel:") | h.startswith("#"))).withColumn("target", resolve("url", "href"))
    host = lambda c: F.try_parse_url(F.col(c), F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(F.col("target"), F.lit("PATH")), F.lit(""))
    own = F.lit(domain) if domain else host("url")
    short = F.regexp_replace(path, "/+$", "")
    kept = links.where((host("target") == own) & ~F.lower(path).endswith(".pdf") & ~short.isin("", "/en"))
    return kept.select("page_id", "target", F.concat(slug(path), F.lit(".md")).alias("file")).distinct()


@F.pandas_udf(T.StringType())
def without_fragment(url: pd.Series) -> pd.Series:
    return url.map(lambda u: urldefrag(u)[0], na_action="ignore")


def wiki_edges(links: DataFrame, domain: str, ignored: list[str]) -> DataFrame:
    """(source, target) links that a wiki crawl follows: absolute, on the domain, no ignored path, no old revision."""
    t = F.col("target")
    part = lambda p: F.coalesce(F.try_parse_url(t, F.lit(p)), F.lit(""))
    plain = links.where(~F.col("href").startswith("#")).withColumn("target", F.regexp_replace("href", "#.*$", ""))
    return plain.where((part("HOST") == domain) & ~part("PATH").isin(ignored) & ~F.contains(part("QUERY"), F.lit("oldid"))).select("source", "target").distinct()


#: Fronts that the visited set takes up before it is written as one table.
FRONTS = 16


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(page, depth) of all pages that ``start`` (page) reaches over (source, target), by anti joins against the visited set until nothing is new."""
    visited = written(start.select("page", F.lit(0).alias("depth")).distinct(), "visited")
    front = visited.select("page")
    for depth in itertools.count(1):
        new = edges.join(front, edges["source"] == front["page"], "left_semi").select(F.col("target").alias("page")).distinct().join(visited.select("page"), "page", "left_anti")
        new = written(new, "front")
        if new.isEmpty():
            break
        visited = visited.unionByName(new.withColumn("depth", F.lit(depth)))
        if depth % FRONTS == 0:
            visited = written(visited, "visited")
        front = new
    return visited
