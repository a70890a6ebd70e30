"""Course collections: upserts that carry uploads forward, positional updates, change detection, grouping by semester."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bracketed semester, and a pair of them; fixed formats.
SINGLE = r"(?i)\[((?:[FS]|SUM|IBC)\s?\d{2})(?:-MFAI)?\]"
DOUBLE = r"(?i)\[((?:[FS]|SUM|IBC)\s?\d{2})(?:-MFAI)?-((?:[FS]|SUM|IBC)\s?\d{2})(?:-MFAI)?\]"
NO_SEMESTER = "No Semester"


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``target`` with ``incoming`` rows in place of those with the same keys; of several incoming ones the last by ``order``."""
    new = incoming
    if order:
        last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        new = incoming.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).drop("_r", order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def carry_forward(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` modules with ``uploaded`` kept from the stored file where name and both times are the same.

    Null times equal null times. The order of contents is kept; of equal stored names the last counts.
    """
    # a module is one row on either side (``upsert`` sees to it), so its files meet in one join, without being exploded
    held = stored.select("course_id", "module_id", F.col("contents").alias("_held"))

    def kept(c: Column) -> Column:
        s = F.get(F.slice(F.filter("_held", lambda x: x["filename"] == c["filename"]), -1, 1), F.lit(0))
        same = s.isNotNull() & c["timecreated"].eqNullSafe(s["timecreated"]) & c["timemodified"].eqNullSafe(s["timemodified"])
        return c.withField("uploaded", F.when(same, s["uploaded"]).otherwise(c["uploaded"]))

    whole = incoming.join(held, ["course_id", "module_id"], "left")
    none = F.array().cast(incoming.schema["contents"].dataType)
    return whole.withColumn("contents", F.coalesce(F.transform("contents", kept), none)).select(incoming.columns)


def upsert_modules(target: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(target, carry_forward(target, incoming), ["course_id", "module_id"])


def mark_uploaded(contents: Column, filename: Column, created: Column, modified: Column) -> Column:
    """The first content of that name as uploaded, with the given times; the others as they are."""
    first = F.array_position(F.transform(contents, lambda c: c["filename"]), filename) - 1
    done = lambda c: c.withField("uploaded", F.lit(True)).withField("timecreated", created).withField("timemodified", modified)
    return F.transform(contents, lambda c, i: F.when(i == first, done(c)).otherwise(c))


def changed_contents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(course_id, module_id, filename, times) of files to upload: known, and not uploaded yet or of other times."""
    flat = lambda df: df.select("course_id", "module_id", F.posexplode("contents").alias("pos", "c")).select("course_id", "module_id", "pos", "c.*")
    key = ["course_id", "module_id", "filename"]
    old = flat(stored).groupBy(*key).agg(F.max_by(F.struct("timecreated", "timemodified", "uploaded"), "pos").alias("s"))
    new = flat(incoming).where(F.col("type") == "file")
    differs = ~F.coalesce(F.col("s.uploaded"), F.lit(False)) | ~F.col("timecreated").eqNullSafe(F.col("s.timecreated")) | ~F.col("timemodified").eqNullSafe(F.col("s.timemodified"))
    return new.join(old, key).where(differs).select(*key, "timecreated", "timemodified")


def course_names(entries: DataFrame) -> DataFrame:
    return entries.select("course_fullname").distinct()


def ids_by_course(entries: DataFrame, id_col: str = "id") -> DataFrame:
    return entries.groupBy("course_fullname").agg(F.sort_array(F.collect_list(F.col(id_col).cast("string"))).alias("ids"))


def course_sources(entries: DataFrame, name: str) -> DataFrame:
    from siftwell.operators.hydrate import shape_course_rows

    return shape_course_rows(entries.where(F.col("course_fullname") == name))


def courses_by_semester(entries: DataFrame) -> DataFrame:
    """(position, semester, courses): latest first; in a year Sum, S, F, IBC, others; ties by semester.

    A single semester loses its blanks, the two of a pair keep theirs; neither changes case.
    """
    name = F.col("course_fullname")
    one, left, right = F.regexp_extract(name, SINGLE, 1), F.regexp_extract(name, DOUBLE, 1), F.regexp_extract(name, DOUBLE, 2)
    keys = F.when(one != "", F.array(F.replace(one, F.lit(" "), F.lit("")))).when(left != "", F.array(left, right)).otherwise(F.array(F.lit(NO_SEMESTER)))
    groups = course_names(entries).withColumn("semester", F.explode(keys)).groupBy("semester").agg(F.sort_array(F.collect_list("course_fullname")).alias("courses"))
    s = F.col("semester")
    year = F.coalesce(F.regexp_extract(s, r"(\d{2})", 1).try_cast("int"), F.lit(0))
    season = F.when(s.startswith("Sum"), 4).when(s.startswith("S"), 3).when(s.startswith("F"), 2).when(s.startswith("IBC"), 1).otherwise(0)
    # there are as many groups as semesters, so one ordering task has little to do
    return groups.withColumn("position", F.row_number().over(Window.orderBy(year.desc(), season.desc(), s))).select("position", "semester", "courses")
