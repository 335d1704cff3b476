"""Queries of the file catalogue, the embedding cache and the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalog, fulltext, vectors
from tidemark.plans import tables
from tidemark.plans.tables import FILES, table

NOW = "2024-01-01 00:00:00"


def _files(spark, sf):
    long_ago = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    return tables.files(spark, sf).withColumns({"created_at": long_ago, "updated_at": long_ago})


def _now():
    return F.to_timestamp(F.lit(NOW))


def text_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


def needs_ingest(spark, sf):
    """Spanish files are newer than the catalogue says, French ones have other content and are newer."""
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    listing = docs.select(
        path.alias("file_path"),
        (F.col("n_chars") + F.when(F.col("lang").isin("es", "fr"), 1).otherwise(0)).alias("mtime_ns"),
        F.when(F.col("lang") == "fr", F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")).alias("content"),
    )
    known = _files(spark, sf).where("source <> 'src1'")
    return catalog.needs_ingest(listing, known)


def upsert_files(spark, sf):
    """The catalogue without two sources, then every file of three sources is given anew."""
    files = _files(spark, sf)
    known = files.where("source not in ('src1', 'src2')").drop("source")
    given = files.where("source in ('src1', 'src2', 'src3')").withColumn("status", F.lit("done")).drop("source")
    out = catalog.upsert_files(known, given, _now())
    return out.select("file_path", "status", "chunk_count", (F.col("updated_at") == _now()).alias("touched"), F.when(F.col("file_path").rlike("^/src[12]/"), F.lit(None)).otherwise(F.col("id")).alias("kept_id"))


def reset_processing(spark, sf):
    out = catalog.reset_processing(_files(spark, sf), _now())
    return out.select("id", "status", "error_msg", (F.col("updated_at") == _now()).alias("touched"))


def set_status(spark, sf):
    files = _files(spark, sf)
    changes = files.where("status = 'pending'").select("file_path", F.lit("error").alias("status"), F.lit("no parser").alias("error_msg"))
    return catalog.set_status(files, changes, _now()).select("id", "status", "error_msg")


def _chunk_rows(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), F.col("doc_id").alias("vector_id"), F.length("text").alias("char_count"), F.lit(0).alias("position"))


def cleanup_deleted(spark, sf):
    files = _files(spark, sf)
    return catalog.deleted_files(files, files.where("source <> 'src1'"), _chunk_rows(spark, sf)).select("id", "file_name", F.array_join("vector_ids", ",").alias("vector_ids"))


def cleanup_cascade(spark, sf):
    """Chunks that are left after the files of a source are gone."""
    files = _files(spark, sf)
    chunks = _chunk_rows(spark, sf)
    gone = catalog.deleted_files(files, files.where("source <> 'src1'"), chunks)
    return catalog.without(chunks, gone).select("id", "file_id", "char_count")


def replace_chunks(spark, sf):
    """Every file of a source gets two chunks instead of its one; another source's files lose theirs."""
    files, chunks = _files(spark, sf), _chunk_rows(spark, sf)
    touched = files.where("source in ('src1', 'src2')").select(F.col("id").alias("file_id"))
    given = files.where("source = 'src1'").select(F.col("id").alias("file_id"), F.lit(0).cast("long").alias("vector_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).withColumn("char_count", F.col("position") + 10)
    return catalog.replace_chunks(chunks, given, touched).select("file_id", "position", "id", "char_count")


def fts_backfill_missing(spark, sf):
    chunks = tables.chunks(spark, sf)
    return catalog.not_indexed(chunks, table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))).select("chunk_id", F.size(fulltext.T.terms(F.col("text"))).alias("n_terms"))


def _favorites(spark, sf):
    return table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("file_id"), F.timestamp_seconds(F.col("doc_id")).alias("created_at"))


def favorites_list(spark, sf):
    return catalog.favorite_files(_files(spark, sf), _favorites(spark, sf)).select("id", "file_name", F.unix_timestamp("favorite_at").alias("favorite_at"))


def favorites_toggle(spark, sf):
    """Each user event toggles the file of the user's number."""
    toggles = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("file_id"))
    return catalog.toggle_favorites(_favorites(spark, sf), toggles, _now()).select("file_id", (F.col("created_at") == _now()).alias("is_new"))


def list_files_by_status(spark, sf):
    return catalog.by_status(_files(spark, sf), "error").select("id", "file_path", "status")


def file_lookup(spark, sf):
    """Files of the questions' numbers, by id."""
    asked = tables.questions(spark, sf).select(F.col("query_id").alias("id"))
    return _files(spark, sf).join(asked, "id").select("id", "file_path", "status")


def file_chunk_sample(spark, sf):
    """Sources as files, documents as their chunks."""
    rows = table(spark, sf, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("id"), (F.col("n_chars") % 7).alias("page_num"))
    return catalog.chunk_sample(rows).select("file_id", "id", "page_num", "rank")


def embedding_cache_plan(spark, sf):
    """Every labelled document's text is in the cache."""
    chunks = tables.chunks(spark, sf)
    cache = chunks.join(table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id").select(F.lit("torch::m").alias("model_name"), F.sha2("text", 256).alias("text_hash")).distinct()
    return vectors.cache_counts(vectors.cache_plan(chunks, cache, vectors.encoder_key("torch", "m")))


def adaptive_batch_size(spark, sf):
    by = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.floor(F.avg(F.length("text"))).alias("average"))
    return by.select("source", vectors.adaptive_batch(F.col("n"), F.col("average"), 32768, 64).cast("long").alias("batch"))


def cost_attribution(spark, sf):
    batch = table(spark, sf, "documents").select("doc_id", "source", F.ceil(F.length("text") / 1024).alias("chunks"))
    return catalog.attributed_cost(batch, 10.0, "source").select("doc_id", F.round("embed_s", 6).alias("embed_s"))


def _history(spark, sf):
    talk = table(spark, sf, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"], "left")


def history_recent(spark, sf):
    """The fifty newest questions with their answers."""
    out = _history(spark, sf).orderBy(F.desc("conv_id"), F.desc("turn")).limit(50)
    return out.select("conv_id", "turn", F.length("question").alias("question_chars"), F.length("answer").alias("answer_chars"))


#: Expressions asked of the history: substrings, alternatives, a phrase, an exclusion, and one that is no expression.
ASKED = ("einach", "que la OR ithth", '"en la"', "the NOT ent", "a-b", "ere AND ing OR ung")


def history_index_search(spark, sf):
    """Substring search for fixed expressions among all questions."""
    rows = _history(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("question").alias("text"))
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, question string")
    return fulltext.trigram_topk(rows, asked).select("query_id", "chunk_id", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        text_sha256, needs_ingest, upsert_files, reset_processing, set_status, cleanup_deleted, cleanup_cascade, replace_chunks, fts_backfill_missing,
        favorites_list, favorites_toggle, list_files_by_status, file_lookup, file_chunk_sample, embedding_cache_plan, adaptive_batch_size,
        cost_attribution, history_recent, history_index_search,
    )
}

HISTORY = """
history as (
  select q.conv_id, q.turn, q.text as question, a.text as answer
  from conversations q left join conversations a on a.role = 'assistant' and a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user')"""
FAVORITES = "fav as (select doc_id as file_id from labels where quality = 1)"

ORACLE_SQL = {
    "text_sha256": "select doc_id, sha256(text) as text_hash from documents",
    "needs_ingest": f"""with {FILES},
listing as (select '/' || source || '/doc_' || doc_id || '.txt' as file_path, n_chars + case when lang in ('es', 'fr') then 1 else 0 end as mtime_ns,
  sha256(case when lang = 'fr' then text || '!' else text end) as new_hash from documents)
select l.file_path, case when f.id is null or f.status in ('error', 'processing') then true when f.mtime_ns <> 0 and l.mtime_ns <= f.mtime_ns then false else new_hash <> f.file_hash end as need,
  case when f.id is null or f.status in ('error', 'processing') or (f.mtime_ns <> 0 and l.mtime_ns <= f.mtime_ns) then null else new_hash end as file_hash
from listing l left join (select * from files where source <> 'src1') f using (file_path)""",
    "upsert_files": f"""with {FILES}
select file_path, case when source in ('src1', 'src2', 'src3') then 'done' else status end as status,
  case when source in ('src1', 'src2') then 0 else 1 end as chunk_count, source in ('src1', 'src2', 'src3') as touched,
  case when source in ('src1', 'src2') then null else id end as kept_id from files""",
    "reset_processing": f"""with {FILES} select id, case status when 'processing' then 'error' else status end as status,
  case status when 'processing' then '{catalog.INTERRUPTED}' else '' end as error_msg, status = 'processing' as touched from files""",
    "set_status": f"with {FILES} select id, case status when 'pending' then 'error' else status end as status, case status when 'pending' then 'no parser' else '' end as error_msg from files",
    "cleanup_deleted": f"with {FILES} select id, file_name, id::varchar as vector_ids from files where source = 'src1'",
    "cleanup_cascade": "select doc_id as id, doc_id as file_id, length(text) as char_count from documents where source <> 'src1'",
    "replace_chunks": """select doc_id as file_id, 0 as position, doc_id as id, length(text) as char_count from documents where source not in ('src1', 'src2')
union all select doc_id, position, (select max(doc_id) from documents) + row_number() over (order by doc_id, position), position + 10
  from documents, (values (0), (1)) v(position) where source = 'src1'""",
    "fts_backfill_missing": """select doc_id as chunk_id, len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) as n_terms from documents
  where doc_id not in (select doc_id from labels) and text <> ''""",
    "favorites_list": f"with {FILES},{FAVORITES} select id, file_name, id as favorite_at from files join fav on id = file_id",
    "favorites_toggle": f"""with {FAVORITES}, odd as (select user_id::bigint as file_id from events group by 1 having count(*) % 2 = 1)
select file_id, false as is_new from fav where file_id not in (select file_id from odd) union all select file_id, true from odd where file_id not in (select file_id from fav)""",
    "list_files_by_status": f"with {FILES} select id, file_path, status from files where status = 'error'",
    "file_lookup": f"with {FILES} select id, file_path, status from files where id in (select item_id from benchmark)",
    "file_chunk_sample": """select file_id, id, page_num, rank from (
  select *, row_number() over (partition by file_id order by page_num, id) - 1 as rank from (
    select source as file_id, doc_id as id, n_chars % 7 as page_num, row_number() over (partition by source order by doc_id) as n from documents) where n <= 45) where rank < 15""",
    "embedding_cache_plan": """with h as (select sha256(text) as text_hash, count(*) as times from documents group by all),
c as (select distinct sha256(text) as text_hash from documents join labels using (doc_id))
select coalesce(sum(times) filter (c.text_hash is not null), 0)::bigint as cache_hits, coalesce(sum(times) filter (c.text_hash is null), 0)::bigint as cache_misses,
  count(*) filter (c.text_hash is null) as to_encode from h left join c using (text_hash)""",
    "adaptive_batch_size": "select source, least(count(*), least(64, greatest(1, floor(32768 / greatest(1, floor(avg(length(text))))))))::bigint as batch from documents group by source",
    "cost_attribution": """select doc_id, round(10.0::double * ceil(length(text) / 1024) / sum(ceil(length(text) / 1024)) over (partition by source), 6) as embed_s from documents""",
    "history_index_search": f"""with {HISTORY},
chunks as (select conv_id * 1000 + turn as chunk_id, lower(question) as low, length(question) - 2 as len from history where question <> ''),
words(query_id, alternative, excludes, word) as (values (0, 0, false, 'einach'), (1, 0, false, 'que'), (1, 1, false, 'ithth'), (2, 0, false, 'en la'),
  (3, 0, false, 'the'), (3, 0, true, 'ent'), (5, 0, false, 'ere'), (5, 0, false, 'ing'), (5, 1, false, 'ung')),
counted as (
  select word, chunk_id, len, len(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(word)) = word)) as f
  from (select distinct word from words) cross join chunks),
hits as (select *, count(*) over (partition by word) as n from counted where f > 0),
stats as (select count(*) as n_chunks, avg(greatest(len, 0)) as avglen from chunks),
parts as (
  select query_id, alternative, chunk_id, count(*) as there, sum(greatest(ln((n_chunks - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avglen))) as part
  from words join hits using (word) cross join stats where not excludes group by all),
scored as (
  select query_id, chunk_id, round(sum(part), 6) as score
  from parts p join (select query_id, alternative, count(*) as words from words where not excludes group by all) using (query_id, alternative)
  where there = words and not exists (select 1 from words w join hits h using (word) where w.excludes and w.query_id = p.query_id and w.alternative = p.alternative and h.chunk_id = p.chunk_id)
  group by all)
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from scored) where rank < 20""",
    "history_recent": f"with {HISTORY} select conv_id, turn, length(question) as question_chars, length(answer) as answer_chars from history order by conv_id desc, turn desc limit 50",
}
