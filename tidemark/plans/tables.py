"""The retrieval model's tables over the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one chunk each; the language stands for the kind of chunk."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    kind = F.when(F.col("lang") == "de", "table").when(F.col("lang") == "fr", "table_summary").otherwise("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        name.alias("file_name"),
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), name).alias("file_path"),
        F.lit(1).alias("page_num"),
        F.col("source").alias("section"),
        kind.alias("chunk_type"),
        "text",
    )


CHUNKS = """
chunks as (
  select doc_id as chunk_id, 'doc_' || doc_id || '.txt' as file_name, '/' || source || '/doc_' || doc_id || '.txt' as file_path,
         1 as page_num, source as section, case lang when 'de' then 'table' when 'fr' then 'table_summary' else 'text' end as chunk_type, text
  from documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question i asks with vector i."""
    asked = questions(spark, sf_dir).select("query_id")
    return vectors(spark, sf_dir).join(asked, F.col("chunk_id") == F.col("query_id")).select("query_id", "vector")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file catalogue: labels stand for what became of a file, ``n_chars`` for its last change."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "done").when(F.col("toxic") == 1, "processing").when(F.col("quality") == 0, "error").otherwise("pending")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), name).alias("file_path"),
        name.alias("file_name"),
        F.sha2("text", 256).alias("file_hash"),
        status.alias("status"),
        F.lit(1).alias("total_pages"),
        F.lit(False).alias("is_scanned"),
        F.lit(1).alias("chunk_count"),
        F.lit("").alias("error_msg"),
        F.array("lang").alias("tags"),
        F.col("n_chars").alias("mtime_ns"),
        F.col("source"),
    )


FILES = """
files as (
  select d.doc_id as id, '/' || source || '/doc_' || d.doc_id || '.txt' as file_path, 'doc_' || d.doc_id || '.txt' as file_name,
         sha256(text) as file_hash,
         case when quality = 1 then 'done' when toxic = 1 then 'processing' when quality = 0 then 'error' else 'pending' end as status,
         1 as total_pages, false as is_scanned, 1 as chunk_count, '' as error_msg, n_chars as mtime_ns, source
  from documents d left join labels l on l.doc_id = d.doc_id)"""
