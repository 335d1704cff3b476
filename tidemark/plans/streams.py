"""Queries of continuous ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.tables import table
from tidemark.sources.shared import shared_folder
from tidemark.streaming import ingest, watch

#: The driver's events are hours apart: a throttle of three seconds would never act.
HOURS = 24


def watch_throttle(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    return ingest.throttle(events.withColumn("at", F.col("us") / 1e6), HOURS * 3600.0).select("event_id", F.col("path").cast("long").alias("user_id"))


def submit_dedupe(spark, sf):
    """Users as paths: a purchase says that a path is done, every other event submits it."""
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("path"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("done"))
    return ingest.once_while_tracked(events).select("event_id", F.col("path").alias("user_id"), "accepted")


def microbatch_pack(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("queue"), F.col("doc_id").alias("position"), F.ceil(F.length("text") / 100).alias("chunks"))
    return ingest.micro_batches(docs).select(F.col("queue").alias("source"), F.col("position").alias("doc_id"), "batch")


def file_events(spark, sf):
    """Documents as files: those with a label were listed before, toxic ones with another length."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    listing = table(spark, sf, "documents").select(path.alias("path"), F.timestamp_seconds("n_chars").alias("modified"), F.col("n_chars").alias("length"), "doc_id")
    before = listing.join(table(spark, sf, "labels"), "doc_id").select("path", "modified", (F.col("length") + F.col("toxic")).alias("length"))
    return watch.changes(listing.drop("doc_id"), before)


def stream_ingest(spark, sf):
    """Documents as a stream, cut and hashed by the same functions as a batch."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parquet*")

    def write(batch: DataFrame, number: int) -> None:
        batch.select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash")).write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    ingest.run_available(stream, write, f"{run}/state").awaitTermination()
    return spark.read.parquet(f"{run}/out").select("doc_id", "n_chars", "text_hash")


QUERIES = {f.__name__: f for f in (watch_throttle, submit_dedupe, microbatch_pack, file_events, stream_ingest)}

ORACLE_SQL = {
    "watch_throttle": f"""with recursive e as (
  select event_id, user_id, epoch_us(ts)::double / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (
  select event_id, user_id, n, t as prev, true as taken from e where n = 1
  union all
  select e.event_id, e.user_id, e.n, case when e.t - f.prev >= {HOURS * 3600} then e.t else f.prev end, e.t - f.prev >= {HOURS * 3600}
  from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select event_id, user_id from f where taken""",
    "submit_dedupe": """with e as (
  select event_id, user_id, ts, event_type, count(*) filter (event_type = 'purchase') over (partition by user_id order by ts, event_id) as ended from events)
select event_id, user_id, row_number() over (partition by user_id, ended order by ts, event_id) = 1 as accepted from e where event_type <> 'purchase'""",
    "microbatch_pack": f"""with recursive d as (select source, doc_id, ceil(length(text) / 100)::bigint as c, row_number() over (partition by source order by doc_id) as n from documents),
f as (
  select source, doc_id, n, 0::bigint as batch, 1 as files, c as chunks from d where n = 1
  union all
  select d.source, d.doc_id, d.n,
    case when files >= {ingest.MOST_FILES} or chunks >= {ingest.MOST_CHUNKS} or chunks + c > {ingest.MOST_CHUNKS} then batch + 1 else batch end,
    case when files >= {ingest.MOST_FILES} or chunks >= {ingest.MOST_CHUNKS} or chunks + c > {ingest.MOST_CHUNKS} then 1 else files + 1 end,
    case when files >= {ingest.MOST_FILES} or chunks >= {ingest.MOST_CHUNKS} or chunks + c > {ingest.MOST_CHUNKS} then c else chunks + c end
  from f join d on d.source = f.source and d.n = f.n + 1)
select source, doc_id, batch from f""",
    "file_events": """select source || '/' || d.doc_id as path, case when l.doc_id is null then 'created' else 'modified' end as kind
from documents d left join labels l on l.doc_id = d.doc_id where l.doc_id is null or toxic <> 0""",
    "stream_ingest": "select doc_id, length(text) as n_chars, sha256(text) as text_hash from documents",
}
