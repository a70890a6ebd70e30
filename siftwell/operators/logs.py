"""Query log, feedback, chat history, prompts and answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import is_no_info, strip
from siftwell.session import ship, written

#: What a language model is told; fixed values.
REWRITE = "Given the following conversation and a follow up question, rephrase the follow up question to be a standalone question, in its original language.\n\nKeep as much details as possible from previous messages. Keep entity names and all.\n\n"
NOTHING_FOUND = "\n\nNo information was found in the provided contexts. Please apologize and state this strictly in the same language as the question above."
#: Where answers come from if no source is named; fixed values.
DEFAULT_SOURCES = ("moodle", "hotel", "eduwiki", "campuslife", "clubs")


def log_rows(results: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each query, to append to the log: (id, query, wrapped_responses, time_spent, created_at), responses in final order.

    ``time_spent`` comes from ``queries`` where they have it, in seconds.
    """
    spent = F.col("time_spent").cast("double") if "time_spent" in queries.columns else F.lit(None).cast("double")
    responses = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("final_rank", F.struct("source", "score", F.lit(None).cast("string").alias("user_feedback")).alias("r")))).alias("x"))
    return queries.join(responses, "query_id", "left").select(F.col("query_id").alias("id"), "query", F.coalesce(F.transform("x", lambda x: x["r"]), F.array()).alias("wrapped_responses"), spent.alias("time_spent"), F.current_timestamp().alias("created_at"))


def answer_rows(answers: DataFrame, payload: list[str]) -> DataFrame:
    """Rows of the ask and act logs: (id, time_spent, created_at, responses), the payload columns as JSON."""
    return answers.select(F.col("query_id").alias("id"), F.col("time_spent").cast("double").alias("time_spent"), F.current_timestamp().alias("created_at"), F.to_json(F.struct(*payload)).alias("responses"))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a log, a folder a day, so that readers of some days skip the others."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def timed(run: Callable[[], DataFrame]) -> DataFrame:
    """What ``run`` gives, computed here, with the seconds that this took as ``time_spent``."""
    began = time.monotonic()
    done = written(run(), "timed")
    return done.withColumn("time_spent", F.lit(time.monotonic() - began))


def sources_or_default(sources: list[str] | None) -> list[str]:
    """The sources that are asked for; without any, those that answers come from."""
    return list(sources or DEFAULT_SOURCES)


def rewrite_prompt(history: Column, query: Column) -> Column:
    """The request to make a follow-up question stand alone."""
    told = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("Chat History:\n"), history, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(REWRITE), told, F.lit("Follow Up Input: "), query, F.lit("\nStandalone question:"))


def completed(df: DataFrame, prompt_col: str, out_col: str, model: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``df`` with what a language model gives for each prompt, in Arrow batches; a prompt without an answer fails the job."""
    ship(df.sparkSession)
    schema = df.drop(out_col).schema.add(out_col, "string")
    at = df.columns.index(prompt_col)
    kept = [k for k, c in enumerate(df.columns) if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model(batch.column(at).to_pylist())
            if any(x is None for x in found):
                raise RuntimeError("the model gave no answer")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array([x.strip() for x in found], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def rewritten(queries: DataFrame, histories: DataFrame, model: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """(query_id, query, original, history): queries that stand alone; without a model they stay as they are."""
    known = queries.join(histories.select("query_id", "history"), "query_id", "left").withColumn("original", F.col("query"))
    if model is None:
        return known.select("query_id", "query", "original", "history")
    asked = completed(known.withColumn("_prompt", rewrite_prompt(F.col("history"), F.col("query"))), "_prompt", "_answer", model)
    return asked.select("query_id", F.col("_answer").alias("query"), "original", "history")


def no_result_prompt(query: Column) -> Column:
    """What is asked when nothing was found."""
    return F.concat(query, F.lit(NOTHING_FOUND))


def apply_feedback(log: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the log with feedback set by position, what was rejected and why). ``feedback``: (id, response_index, feedback).

    Of several for one response the last (greatest ``seq`` where there is one, else greatest feedback) counts.
    """
    sized = feedback.join(log.select("id", F.size("wrapped_responses").alias("n")), "id", "left")
    why = F.when(F.col("n").isNull(), "unknown id").when((F.col("response_index") < 0) | (F.col("response_index") >= F.col("n")), "index out of range")
    judged = sized.withColumn("reason", why)
    order = "seq" if "seq" in feedback.columns else "feedback"
    good = judged.where(F.col("reason").isNull()).groupBy("id", "response_index").agg(F.max_by("feedback", order).alias("feedback"))
    marks = good.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("response_index", "feedback"))).alias("marks"))
    put = F.transform("wrapped_responses", lambda r, i: r.withField("user_feedback", F.coalesce(F.try_element_at(F.col("marks"), i), r["user_feedback"])))
    done = log.join(marks, "id", "left").withColumn("wrapped_responses", F.when(F.col("marks").isNull(), F.col("wrapped_responses")).otherwise(put)).drop("marks")
    return done, judged.where(F.col("reason").isNotNull()).drop("n")


def append_history(sessions: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions with a user and an assistant turn added, turns refused because the session has another owner).

    ``sessions``: (chat_id, owner, history array<struct<role, content>>); ``turns``: (chat_id, owner, question, answer),
    one a session at most. Unknown sessions are created.
    """
    owners = sessions.select("chat_id", F.col("owner").alias("held_by"))
    known = turns.join(owners, "chat_id", "left")
    fine = known.where(F.col("held_by").isNull() | (F.col("held_by") == F.col("owner"))).drop("held_by")
    refused = known.where(F.col("held_by").isNotNull() & (F.col("held_by") != F.col("owner"))).drop("held_by")
    entry = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    new = fine.select("chat_id", F.col("owner").alias("asked_by"), F.array(entry("user", "question"), entry("assistant", "answer")).alias("added"))
    whole = sessions.join(new, "chat_id", "full")
    kind = sessions.schema["history"].dataType
    empty = F.array().cast(kind)
    return whole.select("chat_id", F.coalesce("owner", "asked_by").alias("owner"), F.concat(F.coalesce("history", empty), F.coalesce("added", empty)).alias("history")), refused


def render_history(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, history): ``role: text`` lines in order of turn."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def build_context(results: DataFrame, queries: DataFrame, language: Column | None = None) -> DataFrame:
    """(query_id, prompt): the question, then each result in a source tag, in final order. Queries without results keep an empty block."""
    part = F.concat(F.lit('<source resource="'), F.col("resource"), F.lit('">\n'), F.col("content"), F.lit("\n</source>"))
    blocks = results.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("final_rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("block"))
    ask = strip(F.col("query"))
    if language is not None:
        ask = F.concat(ask, F.coalesce(F.concat(F.lit("\nAnswer strictly in "), language, F.lit(".")), F.lit("")))
    return queries.join(blocks, "query_id", "left").select("query_id", F.concat(F.lit("Question: "), ask, F.lit("\n\n<context>\n"), F.coalesce("block", F.lit("")), F.lit("\n</context>\n")).alias("prompt"))


def messages(history: Column, prompt: Column, original: Column, rewritten: Column) -> Column:
    """The messages of one request: history goes along only if the query was rewritten."""
    last = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.when(rewritten != original, F.concat(history, last)).otherwise(last)


def gate_results(answer: Column, results: Column) -> Column:
    """No results beside an answer that says it has none."""
    return F.when(is_no_info(answer), F.slice(results, 1, 0)).otherwise(results)


def group_texts(rows: DataFrame, buckets: list[str], bucket: Column, other: str, position: str, text: str, every: str | None = None) -> DataFrame:
    """(bucket, text) for every bucket, empty ones too: texts in order, an empty line after each; unknown kinds go to ``other``.

    ``every`` names one more bucket that takes all rows.
    """
    spark = rows.sparkSession
    kind = F.when(bucket.isin(buckets), bucket).otherwise(F.lit(other))
    if every is not None:
        rows, kind, buckets = rows.withColumn("_bucket", F.explode(F.array(kind, F.lit(every)))), F.col("_bucket"), [*buckets, every]
    joined = rows.groupBy(kind.alias("bucket")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, text))), lambda x: F.concat(x[text], F.lit("\n\n"))), "").alias("content"))
    fixed = spark.createDataFrame([(b,) for b in buckets], "bucket string")
    return fixed.join(joined, "bucket", "left").select("bucket", F.coalesce("content", F.lit("")).alias("content"))


def latest(log: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))).where(F.col("_r") == 1).drop("_r")
