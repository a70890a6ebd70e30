"""Documents to prefixed, overlapping chunks, and the index table of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import clean_text, html_escape

SIZE, OVERLAP = 512, 128


def tokens(text: Column) -> Column:
    """Default tokenizer: runs without white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), "")


def chunk(df: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``df`` without its text, a row for each chunk: ``chunk_number`` from 0, ``n_tokens``, ``content``.

    Chunks begin every size - overlap tokens; the last is the first that reaches the end. No tokens, no chunk.
    """
    stride = size - overlap
    t = df.withColumn("_t", tokens(clean_text(F.col(text_col)))).drop(text_col)
    last = F.when(F.size("_t") == 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.ceil((F.size("_t") - size) / F.lit(stride)))).cast("int")
    each = t.withColumn("chunk_number", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    part = F.slice("_t", F.col("chunk_number") * stride + 1, size)
    return each.withColumn("n_tokens", F.size(part)).withColumn("content", F.array_join(part, " ")).drop("_t")


def prefix_large(content: Column, number: Column, url: Column, title: Column) -> Column:
    """A chunk behind its tag; without url or title the chunk alone."""
    tag = F.concat(F.lit("<chunk chunk_number="), number.cast("string"), F.lit(' source_url="'), html_escape(url), F.lit('" source_page_title="'), html_escape(title), F.lit('">\n'))
    return F.concat(F.coalesce(tag, F.lit("")), content)


def prefix_map(content: Column, url: Column, hint: str = "This is a entry pointing to some room") -> Column:
    """The one chunk of a map entry: cleaned, whole, directly behind its tag."""
    tag = F.concat(F.lit('<chunk chunk_number=0 location_url="'), html_escape(url), F.lit(f'" hint="{hint}">'))
    return F.concat(F.coalesce(tag, F.lit("")), clean_text(F.coalesce(content, F.lit(""))))


def index_rows(docs: DataFrame, resource: str) -> DataFrame:
    """(resource, mongo_id, chunk_number, content) of one source's documents, ready to be embedded."""
    if resource == "moodle":
        raise ValueError("this source is not indexed")
    if resource == "maps":
        return docs.select(F.lit(resource).alias("resource"), F.col("id").alias("mongo_id"), F.lit(0).alias("chunk_number"), prefix_map(F.col("content"), F.col("location_url")).alias("content"))
    parts = chunk(docs.select("id", "source_url", "source_page_title", "content").withColumnRenamed("content", "text"))
    return parts.select(F.lit(resource).alias("resource"), F.col("id").alias("mongo_id"), "chunk_number", prefix_large(F.col("content"), F.col("chunk_number"), F.col("source_url"), F.col("source_page_title")).alias("content"))


#: What the index holds.
INDEX = "resource string, mongo_id string, chunk_number int, content string, embedding array<float>"


def write_index(rows: DataFrame, path: str, resource: str | None = None) -> DataFrame:
    """Replaces the partitions of the sources in ``rows`` and no others; returns the rows without vectors.

    A ``resource`` that is named is replaced also where no row of it is left.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resource").parquet(path)
    if resource is not None and rows.where(F.col("resource") == resource).isEmpty():
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/resource={resource}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return spark.read.schema(rows.schema).parquet(path).drop("embedding")


def read_index(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """The index's chunks of the given sources; those that were never indexed, or an index that is not there, give none."""
    try:
        found = spark.read.schema(INDEX).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], INDEX)
    found = found.select("resource", "mongo_id", "chunk_number", "content", "embedding")
    return found if sources is None else found.where(F.col("resource").isin(sources))
