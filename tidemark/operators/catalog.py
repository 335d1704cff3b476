"""The file catalogue as transforms from tables to tables.

Plain tables have no UPDATE or DELETE: every change is a new version of a table, written as a snapshot
(``tidemark.sources.snapshots``). Nothing here collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERRUPTED = "Interrupted (server restart)"
#: What a file's row has besides its key and id; ``chunk_count`` and ``created_at`` survive an upsert.
GIVEN = ("file_name", "file_hash", "status", "total_pages", "is_scanned", "tags", "mtime_ns")


def needs_ingest(listing: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_path, need, file_hash)`` for ``listing(file_path, mtime_ns, content)``.

    New files and those whose last run failed or broke off are needed, without a hash. A file that is
    not newer is not. Only what is left is hashed, and needed if the hash differs.
    """
    known = files.select("file_path", F.col("file_hash").alias("old_hash"), "status", F.col("mtime_ns").alias("old_mtime"))
    both = listing.join(known, "file_path", "left")
    again = F.col("status").isNull() | F.col("status").isin("error", "processing")
    unchanged = (F.coalesce("old_mtime", F.lit(0)) != 0) & (F.col("mtime_ns") <= F.col("old_mtime"))
    none = F.lit(None).cast("string")
    quick = both.where(again | unchanged).select("file_path", again.alias("need"), none.alias("file_hash"))
    rest = both.where(~(again | unchanged)).withColumn("file_hash", F.sha2("content", 256))
    return quick.unionByName(rest.select("file_path", ~F.col("old_hash").eqNullSafe(F.col("file_hash")), "file_hash").toDF("file_path", "need", "file_hash"))


#: Keys looked at for every range of the order.
SAMPLED = 20


def new_ids(rows: DataFrame, order: str, after: DataFrame) -> DataFrame:
    """``rows`` with ``id`` counting on from ``after(last)``, in the order of the string column ``order``.

    Rows are dealt to ranges of the order, bounded by keys of a fixed sample (``SAMPLED`` a range); a range's ids
    start after the sum of the ranges below, so no task sees them all. Keys are unlike each other and not null.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The rows with the smallest hashes: a rerun draws the same.
    keys = sorted(r[0] for r in rows.select(order).orderBy(F.xxhash64(order), order).limit(SAMPLED * n).collect())
    bounds = F.array(*map(F.lit, keys[SAMPLED::SAMPLED])).cast("array<string>")
    dealt = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(order))))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    below = sizes.withColumn("_below", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    named = dealt.join(F.broadcast(below.drop("_n")), "_range").crossJoin(F.broadcast(after))
    return named.withColumn("id", F.col("last") + F.col("_below") + nth).drop("_range", "_below", "last")


def upsert_files(files: DataFrame, given: DataFrame, now: Column) -> DataFrame:
    """``files`` after ``given(file_path, ...)``: known paths are overwritten and keep their id, chunk count
    and creation; new ones get ids after the largest. ``given`` has one row per path."""
    updated = files.join(given.select("file_path", *(F.col(c).alias(f"new_{c}") for c in GIVEN), F.lit(True).alias("hit")), "file_path", "left")
    hit = F.coalesce("hit", F.lit(False))
    updated = updated.withColumns({c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in GIVEN} | {"error_msg": F.when(hit, F.lit("")).otherwise(F.col("error_msg")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    fresh = given.join(files.select("file_path"), "file_path", "left_anti")
    fresh = new_ids(fresh, "file_path", files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")))
    fresh = fresh.withColumns({"chunk_count": F.lit(0), "error_msg": F.lit(""), "created_at": now, "updated_at": now})
    return updated.select(*files.columns).unionByName(fresh.select(*files.columns))


def reset_processing(files: DataFrame, now: Column) -> DataFrame:
    """Files that a crash left in processing become errors, to be taken up again."""
    stuck = F.col("status") == "processing"
    return files.withColumns({"error_msg": F.when(stuck, F.lit(INTERRUPTED)).otherwise(F.col("error_msg")), "updated_at": F.when(stuck, now).otherwise(F.col("updated_at")), "status": F.when(stuck, "error").otherwise(F.col("status"))})


def set_status(files: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``changes(file_path, status, error_msg)`` applied; no message clears the old one."""
    named = changes.select("file_path", F.col("status").alias("to"), F.coalesce("error_msg", F.lit("")).alias("said"))
    both = files.join(named, "file_path", "left")
    hit = F.col("to").isNotNull()
    out = both.withColumns({"status": F.coalesce("to", "status"), "error_msg": F.when(hit, F.col("said")).otherwise(F.col("error_msg")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return out.select(*files.columns)


def deleted_files(files: DataFrame, listing: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(id, file_name, vector_ids)`` of the files that are no longer in the listing."""
    gone = files.join(listing.select("file_path"), "file_path", "left_anti").select("id", "file_name")
    ids = chunks.groupBy("file_id").agg(F.sort_array(F.collect_list("vector_id")).alias("vector_ids"))
    return gone.join(ids, F.col("id") == F.col("file_id"), "left").select("id", "file_name", F.coalesce("vector_ids", F.array().cast("array<bigint>")).alias("vector_ids"))


def without(rows: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """``rows`` of files that stay: one step of the cascade over chunks, indexes, vectors and favourites."""
    return rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def replace_chunks(chunks: DataFrame, given: DataFrame, touched: DataFrame) -> DataFrame:
    """All chunks of the touched files replaced by ``given``; a touched file without any loses its own.

    New chunks get ids after the largest, in the order of ``(file_id, position)``.
    """
    kept = chunks.join(touched.select("file_id"), "file_id", "left_anti")
    ordered = given.withColumn("_order", F.concat(F.lpad(F.col("file_id").cast("string"), 20, "0"), F.lit("/"), F.lpad(F.col("position").cast("string"), 12, "0")))
    fresh = new_ids(ordered, "_order", chunks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")))
    return kept.unionByName(fresh.select(*chunks.columns))


def not_indexed(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunks with text that the index does not hold."""
    return chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti").where(F.coalesce(F.col("text"), F.lit("")) != "")


def toggle_favorites(favorites: DataFrame, toggles: DataFrame, now: Column) -> DataFrame:
    """Favourites after all toggles: an even number of them changes nothing."""
    odd = toggles.groupBy("file_id").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("file_id")
    stay = favorites.join(odd, "file_id", "left_anti")
    return stay.unionByName(odd.join(favorites.select("file_id"), "file_id", "left_anti").withColumn("created_at", now).select(*favorites.columns))


def favorite_files(files: DataFrame, favorites: DataFrame) -> DataFrame:
    """Files with a favourite, and when; order by ``favorite_at`` descending to list them."""
    return files.join(favorites.select(F.col("file_id").alias("id"), F.col("created_at").alias("favorite_at")), "id")


def by_status(files: DataFrame, status: str | None = None) -> DataFrame:
    return files if status is None else files.where(F.col("status") == status)


def chunk_sample(chunks: DataFrame, most: int = 15) -> DataFrame:
    """Up to ``most`` chunks of every file by page, among its first three times as many by id."""
    early = F.row_number().over(Window.partitionBy("file_id").orderBy("id"))
    by_page = F.row_number().over(Window.partitionBy("file_id").orderBy("page_num", "id"))
    return chunks.withColumn("_n", early).where(F.col("_n") <= 3 * most).withColumn("_n", by_page).where(F.col("_n") <= most).withColumn("rank", F.col("_n").cast("long") - 1).drop("_n")


def attributed_cost(batch: DataFrame, seconds: float, group: str) -> DataFrame:
    """A batch's encoding time shared among its files by their chunks.

    Totals are summed before they move and come back by a join, so a batch may hold any share of the rows; files
    without a batch are one of their own.
    """
    totals = batch.groupBy(F.col(group).alias("_of")).agg(F.sum("chunks").alias("_total"))
    share = F.when(F.col("_total") > 0, F.lit(seconds) * F.col("chunks") / F.col("_total")).otherwise(F.lit(0.0))
    return batch.join(totals, F.col(group).eqNullSafe(F.col("_of"))).withColumn("embed_s", share).drop("_of", "_total")
