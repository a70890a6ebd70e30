"""A training-data pipeline over ``documents``: quality, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's docs.
All but the last return the columns of their input, ``documents``' and any more, whatever their names. Models are trained on the
stage's own input. An empty table goes through all stages as one; texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import jaccard, langid, packing, pii, quality
from siftwell.llm.common import read, written


def _whole(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): each row as a struct, so that no column of an operator clashes with one of the table's."""
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the learned decision list rejects: null, empty and short texts among them; equal rows fare alike."""
    rules = quality.learn_from(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return quality.judge(_whole(docs), rules).where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no known language: null texts and those without a letter; all, where no row has a language."""
    found = langid.predict(_whole(docs), langid.training_text(docs.select("doc_id", "text", "lang")), keep=["row"])
    return found.where(F.col("lang_pred") != "und").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of links: that of smallest id, null ids last; wordless texts link with nothing."""
    # rows are linked, not ids, which may repeat or be null: each gets a key that stays as it is once written
    keyed = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "keyed")
    found = jaccard.join(keyed.select(F.col("key").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("key"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = keyed.select("key", "row.doc_id").join(found, "key").groupBy("component_id").agg(F.min(order)["key"].alias("key"))
    return keyed.join(first, "key", "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by what kind it was, and the length of such texts; null texts stay null, every row stays."""
    done = pii.redacted(pii.find(_whole(docs))).withColumn("found", F.size("pii") > 0)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("found"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences; a null text is one piece that holds the end id, a row that repeats is packed again."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Models, links and packing are not SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
