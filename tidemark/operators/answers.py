"""Answers and summaries: prompts are built in the plan, the model is a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import catalog, fusion

#: What is said without sources, and how a prompt is laid out.
NOT_FOUND = "在现有文档中未找到相关信息。"
NO_CONTENT = "（无内容可摘要）"
SUMMARY_RULE = "\n\n---\n\n"


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("问题："), question, F.lit("\n\n文档片段：\n"), context)


def first_source(question: Column, context: Column) -> Column:
    """The default answer: the text of the best source, without a model."""
    return F.regexp_extract(context, r"(?s)\A[^\n]*\n(.*?)(?:\n\n---\n\n|\z)", 1)


def answer(questions: DataFrame, hits: DataFrame, model: Callable[[Column, Column], Column] = first_source) -> DataFrame:
    """``(query_id, question, answer, citations)``; questions without hits get the fixed text and no citations.

    ``model(question, context)`` is a Column: an expression or a pandas UDF over ``prompt(...)``.
    """
    cited = F.struct("rank", "file_name", "file_path", "page_num", F.substring("text", 1, fusion.SNIPPET).alias("snippet"), F.coalesce("rerank_score", "rrf_score", F.lit(0.0)).alias("score"))
    sources = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(cited)).alias("citations"))
    both = questions.join(fusion.contexts(hits), "query_id", "left").join(sources, "query_id", "left")
    said = F.when(F.col("context").isNull(), F.lit(NOT_FOUND)).otherwise(model(F.col("question"), F.col("context")))
    return both.select("query_id", "question", said.alias("answer"), F.when(F.col("citations").isNull(), F.array().cast(sources.schema["citations"].dataType)).otherwise(F.col("citations")).alias("citations"))


def summaries(files: DataFrame, chunks: DataFrame, model: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(file_id, summary)`` of finished files: their first chunks by page under a heading with their name."""
    done = files.where("status = 'done'").select(F.col("id").alias("file_id"), "file_name")
    sample = catalog.chunk_sample(chunks.join(done.select("file_id"), "file_id", "left_semi"))
    part = F.struct("rank", "text")
    texts = sample.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n").alias("context"))
    both = done.join(texts, "file_id", "left")
    said = F.when(F.col("context").isNull(), F.lit(NO_CONTENT)).otherwise(F.col("context") if model is None else model(F.col("file_name"), F.col("context")))
    return both.select("file_id", F.concat(F.lit("## "), F.col("file_name"), F.lit("\n\n"), said).alias("summary"))


def export(summaries_: DataFrame, order: str = "file_id") -> DataFrame:
    """All summaries as one document, in order: meant for the few files a user has chosen."""
    part = F.struct(order, "summary")
    return summaries_.agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["summary"]), SUMMARY_RULE).alias("markdown"))


