"""The ten contract queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftwell.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftwell.llm.bpe import encode_decode

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm import quality

    docs = read(spark, sf_dir, "documents")
    rules = quality.learn_from(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select("doc_id", *quality.STATISTICS, "base_failed", "kept", "rule")


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm import pii

    return pii.digest(pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from siftwell.llm import langid
    from siftwell.llm.common import is_held_out

    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.training_text(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), F.col("lang_pred"), F.col("score"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm import toxicity
    from siftwell.llm.common import is_held_out

    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.labelled_sample(docs, read(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm import urlfilter

    return urlfilter.judge(read(spark, sf_dir, "pages").select("page_id", "url"))


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm import secrets

    return secrets.find(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from siftwell.llm import ann

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_rows(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm import jaccard

    return jaccard.join(read(spark, sf_dir, "documents"))
