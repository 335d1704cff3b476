"""From two ranked lists per question to an answer's sources: fusion, cut-offs, reranking, citations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions import text as T
from tidemark.operators.vectors import INSTRUCTION

RRF_K = 60
TABLE_BOOST = 1.5
VECTOR_THRESHOLD = 0.4
TOP_FUSED, TOP_RERANKED = 20, 5
RELATIVE_CUTOFF = 0.10
SNIPPET, SAME_TEXT = 200, 128
DIGITS = 6


def route(questions: DataFrame) -> DataFrame:
    """``questions`` with what their wording asks for: keyword and vector weights, and tables."""
    q = F.col("question")
    return questions.withColumns({"bm25_weight": T.keyword_weight(q), "vec_weight": T.vector_weight(q), "prefer_tables": T.asks_for_table(q)})


def rrf(vector_hits: DataFrame, keyword_hits: DataFrame, routed: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal ranks of both lists, summed: ``(query_id, chunk_id, rrf_score, vec_score, place)``.

    Hits are ``(query_id, chunk_id, score, rank)``. With ``kinds(chunk_id, chunk_type)``, tables weigh
    more for the questions that ask for them. ``place`` orders ties: the vector list, then the rest
    of the keyword list.
    """
    v = vector_hits.select("query_id", "chunk_id", F.col("score").alias("vec_score"), F.col("rank").alias("vec_rank"))
    k = keyword_hits.select("query_id", "chunk_id", F.col("rank").alias("key_rank"))
    both = v.join(k, ["query_id", "chunk_id"], "full_outer").join(routed.drop("question"), "query_id")
    part = lambda w, r: F.coalesce(F.col(w) / (RRF_K + F.col(r) + 1), F.lit(0.0))
    score = part("vec_weight", "vec_rank") + part("bm25_weight", "key_rank")
    if kinds is not None:
        both = both.join(kinds.select("chunk_id", "chunk_type"), "chunk_id", "left")
        is_table = F.col("prefer_tables") & F.col("chunk_type").isin("table", "table_summary")
        score = score * F.when(F.coalesce(is_table, F.lit(False)), TABLE_BOOST).otherwise(1.0)
    place = F.coalesce("vec_rank", F.col("key_rank") + 1_000_000)
    return both.select("query_id", "chunk_id", F.round(score, 9).alias("rrf_score"), "vec_score", place.alias("place"))


def over_threshold(fused: DataFrame, threshold: float = VECTOR_THRESHOLD) -> DataFrame:
    """Without the vector hits below the threshold, keyword hits among them or not."""
    return fused.where(F.col("vec_score").isNull() | (F.col("vec_score") >= threshold))


def first(fused: DataFrame, k: int = TOP_FUSED) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "place")
    return fused.withColumn("rank", F.row_number().over(order).cast("long") - 1).where(F.col("rank") < k)


def deduplicate(candidates: DataFrame) -> DataFrame:
    """The best of the candidates with the same file, page and first 128 characters.

    ``candidates`` carry ``file_path, page_num, text``; what stays keeps the place of its group's first.
    """
    same = Window.partitionBy("query_id", "file_path", "page_num", F.substring("text", 1, SAME_TEXT))
    best = same.orderBy(F.desc("rrf_score"), "rank")
    out = candidates.withColumn("nth", F.row_number().over(best)).withColumn("rank", F.min("rank").over(same))
    return out.where("nth = 1").drop("nth")


def lexical_score(question: Column, text: Column) -> Column:
    """The default reranker: the share of the question's distinct terms that the text holds."""
    asked = F.array_distinct(T.terms(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.terms(text))) / F.size(asked)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, questions: DataFrame, k: int = TOP_RERANKED, score=lexical_score) -> DataFrame:
    """The ``k`` best by ``score(question, text)``, without those under a tenth of the best; ``rank`` anew."""
    asked = candidates.join(questions.select("query_id", "question"), "query_id")
    return best_scored(asked.withColumn("rerank_score", score(F.col("question"), F.col("text"))).drop("question"), k)


#: What a reranking model is told, and how a pair is put to it.
SYSTEM = "Judge whether the Document meets the requirements based on the Query and the Instruct, output your judgement in 'yes' or 'no'."
PAIR = "<Instruct>: {instruction}\n<Query>: {query}\n<Document>: {document}"
MOST_TOKENS = 4096


class Judge(Protocol):
    """A model as a worker holds it."""

    def prompt(self, system: str, user: str) -> list[int]:
        """The ids of a conversation that the model is to go on with."""

    def logits(self, ids: list[list[int]]) -> list[tuple[float, float]]:
        """The logits of yes and of no after each prompt."""


_judges: dict[str, Judge] = {}


def _judge(name: str, load: Callable[[], Judge]) -> Judge:
    """The worker's own, which outlives its tasks."""
    if name not in _judges:
        _judges[name] = load()
    return _judges[name]


def judged(candidates: DataFrame, questions: DataFrame, load: Callable[[], Judge], name: str, instruction: str = INSTRUCTION, most_tokens: int = MOST_TOKENS, together: int = 16) -> DataFrame:
    """``candidates`` with ``rerank_score``, a model's probability that the text answers the question.

    A worker loads the model ``name`` once, whatever it scores; pairs go to it ``together`` at a time, prompts cut to
    ``most_tokens``. Null texts are judged as empty. To give up a search, run it under a job tag and interrupt the tag:
    it then ends without rows.
    """
    fields = [f for f in candidates.schema if f.name != "rerank_score"]
    schema = StructType([*fields, StructField("rerank_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judge, scores = _judge(name, load), []
            question, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_question", "text"))
            for at in range(0, len(text), together):
                ids = [judge.prompt(SYSTEM, PAIR.format(instruction=instruction, query=q or "", document=t or ""))[:most_tokens] for q, t in zip(question[at : at + together], text[at : at + together])]
                scores += [1 / (1 + math.exp(max(-700.0, min(700.0, no - yes)))) for yes, no in judge.logits(ids)]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=schema.names)

    asked = questions.select("query_id", F.col("question").alias("_question"))
    return candidates.drop("rerank_score").join(asked, "query_id").select(*(f.name for f in fields), "_question").mapInArrow(run, schema)


def best_scored(scored: DataFrame, k: int = TOP_RERANKED) -> DataFrame:
    """The ``k`` best by ``rerank_score``, without those under a tenth of the best; ``rank`` anew."""
    scored = scored.withColumn("rerank_score", F.round("rerank_score", DIGITS))
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    kept = scored.withColumn("best", best).where(F.col("rerank_score") >= RELATIVE_CUTOFF * F.col("best")).drop("best")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return kept.withColumn("rank", F.row_number().over(order).cast("long") - 1).where(F.col("rank") < k)


def citations(hits: DataFrame) -> DataFrame:
    """One row per question and file: its best hit (the first of equals), in order of first appearance."""
    by_file = Window.partitionBy("query_id", F.coalesce(F.nullif("file_path", F.lit("")), "file_name"))
    score = F.coalesce("rerank_score", "rrf_score", F.lit(0.0))
    out = hits.withColumn("raw", score).withColumn("nth", F.row_number().over(by_file.orderBy(F.desc("raw"), "rank")))
    out = out.withColumn("position", F.min("rank").over(by_file)).where("nth = 1")
    return out.select("query_id", "position", "file_name", "file_path", "page_num", F.substring("text", 1, SNIPPET).alias("snippet"), F.bround("raw", 4).alias("score"))


def contexts(hits: DataFrame) -> DataFrame:
    """``(query_id, context)``: the hits' texts under their numbered sources, best first."""
    section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit(" > "), F.col("section"))).otherwise(F.lit(""))
    head = F.concat(F.lit("[片段"), (F.col("rank") + 1).cast("string"), F.lit("] 来源: "), F.col("file_name"), F.lit(", 第"), F.col("page_num").cast("string"), F.lit("页"), section)
    part = F.struct("rank", F.concat(head, F.lit("\n"), F.col("text")).alias("part"))
    # At most k hits per question are gathered here.
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n\n---\n\n").alias("context"))
