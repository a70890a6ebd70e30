"""Pages fetched by a function that the caller may replace: the network, or a table of pages that were fetched before."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import ship
from siftwell.sources import html

Fetch = Callable[[str], tuple[int, str]]


def over_network(url: str, timeout: float = 10.0) -> tuple[int, str]:
    """Status and body."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:
        return r.status, r.read().decode("utf-8", "replace")


def pages(urls: DataFrame, fetch: Fetch = over_network, col: str = "url") -> DataFrame:
    """(url, html, error) of every url: null html, and why, where it could not be fetched or its status was not 200."""
    ship(urls.sparkSession)

    def one(url: str) -> tuple[str | None, str | None]:
        try:
            status, body = fetch(url)
        except (OSError, ValueError, KeyError) as e:
            return None, f"{type(e).__name__}: {e}"
        return (body, None) if status == 200 else (None, f"status {status}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names=["url", "html", "error"])

    return urls.select(F.col(col).alias("url")).where(F.col("url").isNotNull()).mapInArrow(run, "url string, html string, error string")


def listed(spark, list_url: str, fetch: Fetch = over_network, page_parameter: str = "PAGEN_1") -> DataFrame:
    """(url, name) of all cards of a list in pages: the first page's pager says how many there are."""
    ship(spark)
    status, first = fetch(list_url)
    if status != 200:
        raise OSError(f"{list_url}: status {status}")
    n = html.card_links(first)[0]
    base = "/".join(list_url.split("/")[:3])
    numbered = spark.range(1, n + 1).select(F.when(F.col("id") == 1, F.lit(list_url)).otherwise(F.concat(F.lit(f"{list_url}?{page_parameter}="), F.col("id").cast("string"))).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cards = [(base + href if href.startswith("/") else href, name) for body in batch.column(0).to_pylist() for name, href in html.card_links(body or "")[1]]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cards], pa.string()) for k in (0, 1)], names=["url", "name"])

    return pages(numbered, fetch).select("html").mapInArrow(run, "url string, name string").distinct()
