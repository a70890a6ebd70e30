"""Declared schemas, table reads, refreshing writes, and small file sources."""

from __future__ import annotations

import pathlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "source_url", "source_page_title", "content")])
RESOURCE = T.StructType([*PAGE.fields, T.StructField("resource_type", T.StringType())])
MAP = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "location_url", "scene_id", "area_id", "content", "title")])
CONTENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("timecreated", T.LongType()), T.StructField("timemodified", T.LongType()), T.StructField("uploaded", T.BooleanType())])
COURSE_MODULE = T.StructType([T.StructField("id", T.StringType()), T.StructField("course_id", T.LongType()), T.StructField("course_fullname", T.StringType()), T.StructField("section_id", T.LongType()), T.StructField("section_summary", T.StringType()), T.StructField("module_id", T.LongType()), T.StructField("module_name", T.StringType()), T.StructField("module_modname", T.StringType()), T.StructField("contents", T.ArrayType(CONTENT))])
COURSE = T.StructType([T.StructField("course_id", T.LongType()), T.StructField("fullname", T.StringType()), T.StructField("startdate", T.LongType()), T.StructField("enddate", T.LongType()), T.StructField("coursecategory", T.StringType())])
#: One registry of sources; those without an index are reached by their words only.
SOURCES = {name: PAGE for name in ("campuslife", "eduwiki", "clubs", "hotel", "residents")} | {"resources": RESOURCE, "maps": MAP, "moodle": COURSE_MODULE}


def read_collection(spark: SparkSession, root: str, source: str) -> DataFrame:
    """A collection by its declared schema; one that was never written is empty."""
    if source not in SOURCES:
        raise ValueError(f"unknown source: {source}")
    try:
        return spark.read.schema(SOURCES[source]).parquet(f"{root}/{source}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        # a refresh that was stopped between its two moves left the former collection under its second name
        fs, path = _files(spark, root)
        kept = fs.globStatus(path(f"{root}/.{source}-former-*"))
        if kept is not None and len(kept):
            return spark.read.schema(SOURCES[source]).parquet(kept[0].getPath().toString())
        return spark.createDataFrame([], SOURCES[source])


def _files(spark: SparkSession, root: str):
    """The file system that holds ``root``, and its class of paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def refresh(df: DataFrame, root: str, source: str) -> str:
    """Replaces a collection: written beside it first, then the former one is moved aside and the new one into its place.

    A failed write changes nothing; the former collection is deleted last, and readers find it wherever the moves were stopped.
    """
    name = uuid.uuid4().hex
    staged, former, final = f"{root}/.{source}-{name}", f"{root}/.{source}-former-{name}", f"{root}/{source}"
    df.write.parquet(staged)
    fs, path = _files(df.sparkSession, root)
    had = fs.exists(path(final))
    if had and not fs.rename(path(final), path(former)):
        raise OSError(f"cannot move {final}")
    if not fs.rename(path(staged), path(final)):
        if had:
            fs.rename(path(former), path(final))
        raise OSError(f"cannot move {staged} to {final}")
    for old in fs.globStatus(path(f"{root}/.{source}-former-*")) or []:
        fs.delete(old.getPath(), True)
    return final


def parse_object_paths(paths: DataFrame, col: str = "path") -> DataFrame:
    """(course_id, module_id, filename) of ``moodle/<course>/<module>/<file>``; malformed paths go, deeper levels are cut."""
    p = F.split(F.col(col), "/", -1)
    course, module = F.get(p, F.lit(1)).try_cast("long"), F.get(p, F.lit(2)).try_cast("long")
    return paths.where((F.size(p) >= 4) & F.startswith(F.col(col), F.lit("moodle/"))).select(course.alias("course_id"), module.alias("module_id"), F.get(p, F.lit(3)).alias("filename")).where(F.col("course_id").isNotNull() & F.col("module_id").isNotNull())


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of blobs below ``root``, paths relative to it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return found.withColumn("path", F.regexp_replace("path", "^.*?/(?=moodle/)", ""))


def resources_from_yaml(spark: SparkSession, path: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """{type: [entries]} flattened; entries of types other than the given ones (default: any) are left out."""
    import yaml

    data = yaml.safe_load(pathlib.Path(path).read_text(encoding="utf-8")) or {}
    rows = [(None, e.get("source_url"), e.get("source_page_title"), e.get("content"), kind) for kind, entries in data.items() if types is None or kind in types for e in entries or []]
    return spark.createDataFrame(rows, RESOURCE)


def evaluation_sheet(spark: SparkSession, path: str, question: str, links: str) -> DataFrame:
    """(query, expected): a CSV with one question a row and its urls a line each."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(F.col(question).alias("query"), F.filter(F.transform(F.split(F.col(links), "\n"), lambda u: F.trim(u)), lambda u: u != "").alias("expected"))


def dump_markdown(rows: DataFrame, path: str, name: str = "file", content: str = "content") -> None:
    """Texts as files below ``path``, a folder for each name."""
    rows.select(F.col(name).alias("file"), F.col(content).alias("value")).write.mode("overwrite").partitionBy("file").text(path)


LMS_TREE = T.ArrayType(T.StructType([T.StructField("course_id", T.LongType()), T.StructField("course_fullname", T.StringType()), T.StructField("sections", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("summary", T.StringType()), T.StructField("modules", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("modname", T.StringType()), T.StructField("contents", T.ArrayType(CONTENT))])))])))]))


def course_tree(bodies: DataFrame, col: str = "body") -> DataFrame:
    """Pushed JSON trees course > sections > modules > contents, a row for each module."""
    c = bodies.select(F.explode(F.from_json(col, LMS_TREE)).alias("c"))
    s = c.select("c.course_id", "c.course_fullname", F.explode("c.sections").alias("s"))
    m = s.select("course_id", "course_fullname", F.col("s.id").alias("section_id"), F.col("s.summary").alias("section_summary"), F.explode("s.modules").alias("m"))
    return m.select("course_id", "course_fullname", "section_id", "section_summary", F.col("m.id").alias("module_id"), F.col("m.name").alias("module_name"), F.col("m.modname").alias("module_modname"), F.coalesce("m.contents", F.array()).alias("contents"))
