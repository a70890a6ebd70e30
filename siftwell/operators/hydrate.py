"""Hits joined back to their documents and shaped into one wide, tagged row."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import clean_text, preview

LMS_URL = "https://lms.example.org"
#: Where each source's title and link lie; the rest use the default.
FIELDS = {"maps": ("title", "location_url")}
DEFAULT_FIELDS = ("source_page_title", "source_url")


def hydrate_pages(hits: DataFrame, docs: DataFrame, resource: str, path: str = "vector") -> DataFrame:
    """Page-like sources: (query_id, score, type, display_name, url, preview_text, breadcrumbs). Hits without a document go."""
    title, url = FIELDS.get(resource, DEFAULT_FIELDS)
    content = F.coalesce(F.col("content"), F.lit(""))
    text = preview(content) if path == "vector" else content if resource in ("maps", "resources") else clean_text(content)
    own = hits.where(F.col("resource") == resource).select("query_id", "score", F.col("mongo_id").alias("id"))
    return own.join(docs, "id").select("query_id", "score", F.lit(resource).alias("type"), F.coalesce(F.col(title), F.lit("-")).alias("display_name"), F.col(url).alias("url"), text.alias("preview_text"), F.array(F.lit(resource), F.col(title)).alias("breadcrumbs"), (F.col("resource_type") if "resource_type" in docs.columns else F.lit(None).cast("string")).alias("resource_type"))


def course_of(fullname: Column) -> Column:
    return F.substring_index(fullname, " / ", 1)


def shape_course_rows(entries: DataFrame, base_url: str = LMS_URL) -> DataFrame:
    """LMS entries, a row for each of their contents: type, link, urls, display name and breadcrumbs."""
    many = F.size("contents") > 1
    each = entries.withColumn("_many", many).withColumn("c", F.explode("contents"))
    kind = F.when(F.col("c.type") == "file", "moodle-file").when(F.col("c.type") == "url", "moodle-url").otherwise("moodle-unknown")
    link = F.concat(F.lit(f"{base_url}/course/view.php?id="), F.col("course_id").cast("string"), F.lit("#sectionid-"), F.col("section_id").cast("string"), F.lit("-title"))
    url = F.when(F.col("c.type") == "url", F.concat(F.lit(f"{base_url}/mod/url/view.php?id="), F.col("module_id").cast("string"), F.lit("&redirect=1")))
    key = F.when(F.col("c.type") == "file", object_key(F.col("course_id"), F.col("module_id"), F.col("c.filename")))
    display = F.when(F.col("_many"), F.concat_ws(" / ", "module_name", "c.filename")).otherwise(F.col("module_name"))
    crumbs = F.array(F.lit("Moodle"), course_of(F.col("course_fullname")), F.col("module_name"))
    return each.select(*[c for c in entries.columns if c != "contents"], F.col("c.filename").alias("filename"), kind.alias("type"), link.alias("link"), url.alias("url"), key.alias("object_key"), display.alias("display_name"), crumbs.alias("breadcrumbs"))


def object_key(course: Column, module: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("moodle"), course.cast("string"), module.cast("string"), filename)


def hydrate_courses(hits: DataFrame, entries: DataFrame, base_url: str = LMS_URL) -> DataFrame:
    """LMS hits: a row for each content of the entry, all with the hit's score; entries without contents give none."""
    own = hits.where(F.col("resource") == "moodle").select("query_id", "score", F.col("mongo_id").alias("id"))
    return shape_course_rows(own.join(entries, "id"), base_url)


#: One row type for all that is found; what a type does not have is null.
FOUND = "query_id long, score double, type string, display_name string, url string, link string, object_key string, resource_type string, preview_text string, breadcrumbs array<string>"


def tagged(rows: DataFrame) -> DataFrame:
    """Rows of ``hydrate_pages`` or ``hydrate_courses`` as the one row type, told apart by ``type``; any of them unite."""
    kinds = T._parse_datatype_string(FOUND)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields))


def hydrate(hits: DataFrame, collections: dict[str, DataFrame], path: str = "vector", base_url: str = LMS_URL) -> DataFrame:
    """Hits of all sources joined to their documents, as one row type; sources without a collection give nothing. Best first."""
    parts = [tagged(hydrate_courses(hits, docs, base_url) if name == "moodle" else hydrate_pages(hits, docs, name, path)) for name, docs in collections.items()]
    if not parts:
        raise ValueError("no collections")
    return by_score(functools.reduce(DataFrame.unionByName, parts), "type", "display_name", "url")


def by_score(rows: DataFrame, *ties: str) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), *ties)


def semi_join_triples(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole entries that hold any wanted (course_id, module_id, filename)."""
    return entries.join(
        entries.select("course_id", "module_id", F.explode("contents.filename").alias("filename")).join(wanted, ["course_id", "module_id", "filename"], "left_semi").select("course_id", "module_id").distinct(),
        ["course_id", "module_id"],
        "left_semi",
    )
