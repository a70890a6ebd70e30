"""Lexical retrieval: an inverted index and BM25 (k1 1.2, b 0.75)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import written

K1, B = 1.2, 0.75
#: Query terms that are sent to every task; more are joined by a shuffle.
MOST_SENT = 200_000
#: The text fields that each source's index covers.
TEXT_FIELDS = {
    "campuslife": ("source_page_title", "content"),
    "eduwiki": ("source_page_title", "content"),
    "clubs": ("source_page_title", "content"),
    "hotel": ("source_page_title", "content"),
    "residents": ("source_url", "source_page_title", "content"),
    "resources": ("source_page_title", "content"),
    "maps": ("content",),
    "moodle": ("course_fullname", "module_name", "filenames"),
}


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc, tf, length): the inverted index; write it bucketed by term to reuse it."""
    t = docs.select(F.col(id_col).alias("doc"), terms(F.col(text_col)).alias("t"))
    return t.select("doc", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, queries: DataFrame, limit: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc, score), best first, ties by id; ``limit`` of 0 or less keeps all. Query terms are OR-ed, each once."""
    asked = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")), "asked")
    wanted = asked.select("term").distinct()
    # texts are cut into terms once: to the postings of the wanted terms, and one row without a term for each document
    cut = docs.select(F.col(id_col).alias("doc"), terms(F.col(text_col)).alias("t"))
    each = cut.select("doc", F.size("t").alias("length"), F.explode(F.array_append("t", F.lit(None).cast("string"))).alias("term"))
    known = wanted.withColumn("known", F.lit(True))
    known = F.broadcast(known) if asked.count() <= MOST_SENT else known
    kept = each.join(known, "term", "left").where(F.col("known") | F.col("term").isNull())
    seen = written(kept.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("length").alias("length")), "postings")
    size = seen.where(F.col("term").isNull()).agg(F.sum("tf").alias("docs"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("mean"))
    held = seen.where(F.col("term").isNotNull())
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    stats = df.join(F.broadcast(size)).select("term", "mean", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scores = held.join(stats, "term").join(asked, "term").groupBy("query_id", "doc").agg(F.round(F.sum(F.col("idf") * tf), 6).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc")))
    return (ranked if limit <= 0 else ranked.where(F.col("rank") <= limit)).select("query_id", "rank", "doc", "score")


def lexical_hits(collections: dict[str, DataFrame], queries: DataFrame, sections: list[str], limit: int = 10) -> DataFrame:
    """``limit`` hits of each section, in one order over all sections and without a limit over them."""
    found = None
    for s in sections:
        if s not in TEXT_FIELDS:
            raise ValueError(f"unknown section: {s}")
        if s in collections:
            docs = collections[s].select("id", F.concat_ws(" ", *TEXT_FIELDS[s]).alias("text"))
            part = bm25(docs, queries, limit, "id").withColumn("resource", F.lit(s))
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no collection for these sections")
    return found.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "resource", "doc")))


def with_fallback(vector: Callable[[], DataFrame], lexical: Callable[[], DataFrame]) -> DataFrame:
    """The vector path's rows, or the lexical path's where it fails with an error of connection or execution.

    The vector path is run here, to a table, since a plan that is only made fails too late for another one.
    """
    from pyspark.errors import PySparkException

    try:
        return written(vector(), "hits")
    except (ConnectionError, TimeoutError, PySparkException):
        return lexical()


def scored(rows: DataFrame, score: str = "score") -> DataFrame:
    """Rows as (score, inner): what was found apart from how well."""
    return rows.select(F.col(score).alias("score"), F.struct(*(c for c in rows.columns if c != score)).alias("inner"))
