"""A library of documents: ingest, search, answers, and the tables behind them.

Tables are parts under one folder, and a manifest names the parts of all tables: a call writes new parts and
then one manifest, so that one that breaks off leaves the library as it was. Rows that belong to a file carry
its id and the run that wrote them, and the catalogue says which run of a file counts: an ingest appends what
is new and never rewrites old rows, however many there are. ``compact`` drops the rows that no longer count.
The keyword and substring indexes are tables like the others and grow with each ingest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import text as T
from tidemark.operators import answers, catalog, chunking, fulltext, fusion, vectors
from tidemark.sources import files as source
from tidemark.sources import snapshots
from tidemark.streaming import ingest as streaming
from tidemark.streaming.watch import FileWatch

SCHEMAS = {
    "files": "id long, file_path string, file_name string, file_hash string, status string, total_pages int, is_scanned boolean, tags array<string>, mtime_ns long, chunk_count int, error_msg string, created_at timestamp, updated_at timestamp, run string",
    "chunks": "id long, file_id long, run string, position int, chunk_type string, page_num int, section string, text string, char_count int, is_cjk boolean",
    "postings": "file_id long, run string, term string, chunk_id long, tf long",
    "lengths": "file_id long, run string, chunk_id long, len long, chars long",
    "grams": "file_id long, run string, gram string, chunk_id long",
    "vectors": "file_id long, run string, chunk_id long, vector array<float>, list int",
    "centroids": "list int, vector array<double>",
    "cache": "model_name string, text_hash string, vector array<float>",
    "favorites": "file_id long, created_at timestamp",
    "history": "question string, answer string, citations string, created_at timestamp",
}
#: What the tables look like now, and what later versions brought; parts are never rewritten for it.
SCHEMA = 2
CHANGES = (
    snapshots.Change(2, "vectors", "list", str(vectors.NO_LIST)),
    snapshots.Change(2, "lengths", "chars", "null"),
)
#: Tables of rows that count while their file's run does.
BY_RUN = ("chunks", "postings", "lengths", "grams", "vectors")
#: What an ingest goes through, in this order.
STAGES = ("queued", "preparing", "embedding", "storing", "done")


@dataclass
class Library:
    spark: SparkSession
    path: str
    encoder_key: str = "hashed::words"
    encoder: Callable[[DataFrame], DataFrame] = vectors.encode
    threshold: float = fusion.VECTOR_THRESHOLD
    segmenter: fulltext.Segmenter = T.bigrams
    #: From candidates and questions to the best: by shared terms, or by a model (``fusion.judged``, ``fusion.best_scored``).
    reranker: Callable[[DataFrame, DataFrame], DataFrame] = fusion.rerank

    def __post_init__(self):
        #: What is known of parts that this object has written.
        self.written: dict[str, dict] = {}

    def manifest(self) -> dict:
        return snapshots.manifest(self.spark, self.path)

    def commit(self, old: dict, tables: dict[str, list[str]], values: dict | None = None) -> dict:
        return snapshots.commit(self.spark, self.path, old, tables, values, self.written)

    def table(self, name: str, of: dict | None = None, file_ids: list[int] | None = None) -> DataFrame:
        """The rows of a table that count, by the newest manifest or a given one; of some files only, if they are
        named: parts that cannot hold the runs of these are not read."""
        of = of or self.manifest()
        read = lambda t, wanted=None: snapshots.read(self.spark, self.path, t, SCHEMAS[t], of, wanted, CHANGES)
        if name not in BY_RUN:
            return read(name)
        live = read("files").select(F.col("id").alias("file_id"), "run")
        wanted = None
        if file_ids is not None:
            live = live.where(F.col("file_id").isin(*file_ids))
            wanted = [r.asDict() for r in live.collect()]
        return read(name, wanted).join(live, ["file_id", "run"], "left_semi")

    def part(self, name: str, df: DataFrame) -> str:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        path, known = self.counted(name, df.select(*columns), [c for c in ("file_id", "run") if name in BY_RUN])
        self.written[path] = known
        return path

    def counted(self, name: str, df: DataFrame, ranges: list[str]) -> tuple[str, dict]:
        return snapshots.part(df, self.path, name, SCHEMA, ranges)

    def save(self, name: str, df: DataFrame) -> None:
        """A table anew."""
        old = self.manifest()
        self.commit(old, {name: [self.part(name, df)]})

    def staged(self, name: str, df: DataFrame) -> DataFrame:
        """Rows written aside, so that they are worked out once: no manifest names them."""
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.counted(name, df, [])[0]}")

    def report(self, run: str, stage: str, files: int, chunks: int) -> None:
        """Say how far a run is; others see it at once, whatever becomes of the run."""
        row = self.spark.createDataFrame([(run, stage, STAGES.index(stage), files, chunks)], "run string, stage string, nth int, files long, chunks long")
        row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/{snapshots.PROGRESS}")

    def stages(self) -> DataFrame:
        """``(run, stage, nth, files, chunks, at)`` of every stage that a run has reached, the latest first."""
        kept = self.spark.read.schema("run string, stage string, nth int, files long, chunks long, at timestamp")
        return kept.parquet(f"{self.path}/{snapshots.PROGRESS}*").orderBy(F.desc("at"), F.desc("nth"))

    def ingest(self, folders: str | list[source.Watch], recursive: bool = True, extractors=None, only: DataFrame | None = None) -> DataFrame:
        """Bring new and changed files of a folder (or several) in; returns ``(file_path, status, chunk_count)`` of those.

        With ``only(path)`` others stay as they are. ``stages`` tells how far it is.
        """
        now, old = F.current_timestamp(), self.manifest()
        watches = [source.Watch(folders, recursive)] if isinstance(folders, str) else folders
        found = source.scan_all(self.spark, watches).withColumn("file_path", F.col("path"))
        found = found.withColumn("mtime_ns", F.unix_micros("modificationTime") * 1000)
        found = found if only is None else found.join(only.select("path").distinct(), "path", "left_semi")
        run = f"run-{old['version'] + 1}"
        files = self.table("files", old)
        need = catalog.needs_ingest(found.select("file_path", "mtime_ns", "content"), files).where("need").select("file_path")
        taken = found.join(need, "file_path", "left_semi")
        hashed = self.staged("taken", taken.select("file_path", "mtime_ns", F.sha2("content", 256).alias("file_hash")))
        taken_files = hashed.count()
        self.report(run, "queued", taken_files, 0)
        pages = self.staged("pages", source.pages(taken.join(hashed.select("file_path"), "file_path", "left_semi"), extractors))
        by_file = pages.groupBy("path").agg(F.max("page_num").alias("total_pages"), F.flatten(F.collect_list("tags")).alias("tags"), F.max("status").alias("read"), F.max("error_msg").alias("said"), F.max(F.when(F.col("page_num") == 1, T.is_cjk(F.col("text")))).alias("is_cjk"))
        by_file = by_file.join(source.is_scanned(pages), "path")
        read = hashed.join(by_file, F.col("file_path") == F.col("path"))
        status = F.when(F.col("read") == "ok", "done").otherwise(F.when(F.col("read") == "unsupported", "unsupported").otherwise("error"))
        name = F.element_at(F.split("file_path", "/"), -1)
        given = read.select("file_path", name.alias("file_name"), "file_hash", status.alias("status"), "total_pages", "is_scanned", "tags", "mtime_ns")
        # Ids are fixed by a write before chunks refer to them.
        staged = self.staged("new_files", catalog.upsert_files(files.drop("run"), given, now))
        touched = staged.join(read.select("file_path", "said", "is_cjk"), "file_path").select(F.col("id").alias("file_id"), F.col("file_path").alias("path"), "said", "is_cjk")
        keyed = pages.where("status = 'ok'").select(F.to_json(F.struct("path", "page_num")).alias("page_id"), "text")
        at = F.from_json("page_id", "path string, page_num int")
        cut = chunking.page_chunks(keyed).withColumn("at", at).select(F.col("at.path").alias("path"), F.col("at.page_num").alias("page_num"), "position", "chunk_type", "section", "text", "char_count")
        cut = cut.join(touched.select("path", "file_id", "is_cjk"), "path")
        self.report(run, "preparing", taken_files, 0)
        order = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("file_id", 20), ("page_num", 10), ("position", 10))))
        last = self.spark.createDataFrame([(old["values"].get("last_chunk", 0),)], "last long")
        fresh = catalog.new_ids(cut.withColumn("_order", order), "_order", last).withColumn("run", F.lit(run))
        parts = {"chunks": self.part("chunks", fresh)}
        written = self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{self.path}/{parts['chunks']}")
        made = self.written[parts["chunks"]]["rows"]
        self.report(run, "embedding", taken_files, made)
        parts |= self.index_parts(written)
        cache = self.table("cache", old)
        gained = vectors.encode_with_cache(written.select(F.col("id").alias("chunk_id"), "text"), cache, self.encoder_key, self.encoder)[1]
        parts["cache"] = self.part("cache", gained)
        tables = {t: [*old["tables"].get(t, []), p] for t, p in parts.items()}
        others, values = self.vectors_of(written, old, tables["cache"])
        tables["vectors"] = others
        self.report(run, "storing", taken_files, made)
        counts = written.groupBy("file_id").agg(F.count("*").cast("int").alias("n"))
        named = staged.join(touched.select(F.col("file_id").alias("id"), "said", F.lit(run).alias("new_run")), "id", "left").join(files.select("id", F.col("run").alias("old_run")), "id", "left")
        named = named.join(counts.withColumnRenamed("file_id", "id"), "id", "left")
        hit = F.col("new_run").isNotNull()
        rows = named.withColumns({"chunk_count": F.when(hit, F.coalesce("n", F.lit(0))).otherwise(F.col("chunk_count")), "error_msg": F.when(hit, F.coalesce("said", F.lit(""))).otherwise(F.col("error_msg")), "run": F.coalesce("new_run", "old_run")})
        tables["files"] = [self.part("files", rows)]
        top = written.agg(F.max("id")).first()[0]
        self.commit(old, tables, values | {"last_chunk": top or old["values"].get("last_chunk", 0)})
        self.report(run, "done", taken_files, made)
        return self.table("files").where(F.col("run") == run).select("file_path", "status", "chunk_count")

    def follow(self, watch: FileWatch, seconds: float = streaming.THROTTLE_S, every: str | None = None, extractors=None) -> StreamingQuery:
        """Bring in the files that a watch reports, as they come (``every`` so often), or those reported by now.

        A file that is written again and again is taken once in ``seconds``, and not while it is in work.
        """

        def bring_in(batch: DataFrame, number: int) -> None:
            paths = self.staged("submitted", batch.select("path"))
            if not paths.isEmpty():
                self.ingest(watch.watches, extractors=extractors, only=paths)
                watch.finished(paths)

        found = watch.submissions(seconds).writeStream.foreachBatch(bring_in).option("checkpointLocation", f"{watch.state}/followed")
        return (found.trigger(processingTime=every) if every else found.trigger(availableNow=True)).start()

    def index_parts(self, chunks: DataFrame) -> dict[str, str]:
        """Postings, lengths and trigrams of chunks."""
        of = chunks.select(F.col("id").alias("chunk_id"), "file_id", "run")
        named = chunks.withColumnRenamed("id", "chunk_id")
        terms = fulltext.counted_terms(named, self.segmenter)
        rows = {"postings": fulltext.postings_of(terms), "lengths": fulltext.lengths_of(terms).join(named.select("chunk_id", F.length("text").cast("long").alias("chars")), "chunk_id"), "grams": fulltext.trigram_postings(named)}
        return {t: self.part(t, df.join(of, "chunk_id")) for t, df in rows.items()}

    def vectors_of(self, written: DataFrame, old: dict, cache_parts: list[str]) -> tuple[list[str], dict]:
        """The parts of ``vectors`` with the new chunks' own; all live chunks are encoded anew if the encoder has
        changed, or makes vectors of another length."""
        cache = self.spark.read.schema(SCHEMAS["cache"]).parquet(*(f"{self.path}/{p}" for p in cache_parts))
        size = cache.where(F.col("model_name") == self.encoder_key).select(F.size("vector")).limit(1).collect()
        made_by = {"encoder": self.encoder_key, "dims": size[0][0] if size else old["values"].get("dims")}
        same = all(old["values"].get(k) in (None, v) for k, v in made_by.items())
        chunks = written if same else written.unionByName(self.table("chunks", old).select(*written.columns))
        found = vectors.encode_with_cache(chunks.select(F.col("id").alias("chunk_id"), "text"), cache, self.encoder_key, self.encoder)[0]
        rows = found.join(chunks.select(F.col("id").alias("chunk_id"), "file_id", "run"), "chunk_id")
        part = self.part("vectors", vectors.with_list(rows, self.centroids(old) if same else vectors.no_centroids()).sortWithinPartitions("list"))
        return [*(old["tables"].get("vectors", []) if same else []), part], made_by if same else made_by | {"probes": None}

    def centroids(self, of: dict) -> np.ndarray:
        """What the vectors' lists are nearest to; none if they have no lists."""
        if not of["values"].get("probes"):
            return vectors.no_centroids()
        return np.array([r["vector"] for r in self.table("centroids", of).orderBy("list").collect()])

    def index_vectors(self, questions: DataFrame, least: float = 0.9) -> float:
        """Deal all live vectors to lists, so that a question reads the nearest ones only; later ingests just append.

        ``questions`` tell how many lists it takes to find the share ``least`` of what a full search finds; the
        share found is returned and kept. Encoding all chunks anew drops the lists.
        """
        old = self.manifest()
        live = self.table("vectors", old)
        centroids = vectors.train_lists(live)
        part = self.part("vectors", vectors.with_list(live, centroids).repartitionByRange("list").sortWithinPartitions("list"))
        tables = {"vectors": [part], "centroids": [self.part("centroids", self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], SCHEMAS["centroids"]))]}
        listed = self.spark.read.schema(SCHEMAS["vectors"]).parquet(f"{self.path}/{part}")
        probes, share = vectors.probes_for(listed, self.asked(questions), centroids, least)
        self.commit(old, tables, {"probes": probes, "recall": share})
        return share

    def asked(self, questions: DataFrame) -> DataFrame:
        """The questions' vectors."""
        made = self.encoder(questions.select(F.col("query_id").cast("string").alias("key"), vectors.question_text(F.col("question")).alias("text")))
        return made.select(F.col("key").cast("long").alias("query_id"), "vector")

    def backfill(self) -> int:
        """Index the live chunks with text that the keyword index lacks; returns their number."""
        old = self.manifest()
        named = self.table("chunks", old).withColumnRenamed("id", "chunk_id")
        missing = self.staged("missing", catalog.not_indexed(named, self.table("lengths", old)).withColumnRenamed("chunk_id", "id"))
        parts = self.index_parts(missing)
        self.commit(old, {t: [*old["tables"].get(t, []), p] for t, p in parts.items()})
        return missing.count()

    def compact(self, everything: bool = True) -> None:
        """Every table as one part, without the rows that no longer count; or only parts of like size merged, where there
        are many: run after ingests, this keeps the number of parts down and writes a row again seldom."""
        old, tables = self.manifest(), {}
        for t in SCHEMAS:
            if everything and t in old["tables"]:
                tables[t] = [self.part(t, self.table(t, old))]
            for group in [] if everything else snapshots.like_sized(old, t):
                some = self.part(t, self.table(t, old | {"tables": old["tables"] | {t: group}}))
                tables[t] = [*(p for p in tables.get(t, old["tables"][t]) if p not in group), some]
        if tables:
            self.commit(old, tables)

    def vacuum(self) -> None:
        """Remove parts that the newest manifest does not name; no call may be under way."""
        snapshots.remove(self.spark, self.path, snapshots.unnamed(self.spark, self.path))

    def forget_deleted(self, folders: str | list[source.Watch]) -> DataFrame:
        """Drop what belongs to files that are gone from the folders; returns their names and chunk ids."""
        old = self.manifest()
        watches = [source.Watch(folders)] if isinstance(folders, str) else folders
        files = self.table("files", old)
        listing = source.scan_all(self.spark, watches).select(F.col("path").alias("file_path"))
        gone = self.staged("gone", catalog.deleted_files(files, listing, self.table("chunks", old).withColumn("vector_id", F.col("id"))))
        left = {
            "favorites": catalog.without(self.table("favorites", old), gone),
            "files": files.join(gone.select("id"), "id", "left_anti"),
        }
        self.commit(old, {t: [self.part(t, df)] for t, df in left.items()})
        return gone.select("file_name", "vector_ids")

    def payload(self, of: dict | None = None) -> DataFrame:
        of = of or self.manifest()
        named = self.table("files", of).select(F.col("id").alias("file_id"), "file_name", "file_path")
        return self.table("chunks", of).withColumnRenamed("id", "chunk_id").join(named, "file_id")

    def search(self, questions: DataFrame, file_names: list[str] | None = None) -> DataFrame:
        """The best chunks of every question ``(query_id, question)``: both searches, fused and reranked.

        A filter holds for both searches, and a question without a keyword hit in the named files asks for
        substrings in them.
        """
        of = self.manifest()
        payload = self.payload(of)
        lengths = self.table("lengths", of)
        index, grams = fulltext.index_of(self.table("postings", of), lengths), self.table("grams", of)
        allowed = None if file_names is None else F.col("file_name").isin(*file_names)
        keyword = fulltext.search(payload, index, questions, grams=grams, segmenter=self.segmenter, allowed=allowed, stats=self.text_stats(of, lengths))
        held = self.table("vectors", of)
        if file_names is not None:
            named = self.table("files", of).where(allowed).select(F.col("id").alias("file_id"))
            held = held.join(named, "file_id", "left_semi")
        centroids, asked = self.centroids(of), self.asked(questions)
        near = vectors.probe(held, asked, centroids, of["values"]["probes"]) if len(centroids) else vectors.topk(held, asked)
        fused = fusion.rrf(near, keyword, fusion.route(questions), payload.select("chunk_id", "chunk_type"))
        kept = fusion.first(fusion.over_threshold(fused, self.threshold))
        return self.reranker(fusion.deduplicate(kept.join(payload, "chunk_id")), questions)

    def text_stats(self, of: dict, lengths: DataFrame) -> DataFrame | None:
        """What substring search weighs with, from the kept lengths; None if some are older than the counts of characters."""
        newer = all(of["parts"].get(p, {}).get("schema", 1) > 1 for p in of["tables"].get("lengths", []))
        return lengths.agg(F.count("*").alias("n_chunks"), F.avg(F.greatest(F.col("chars") - 2, F.lit(0))).alias("avgchars")) if newer else None

    def ask(self, questions: DataFrame, model=answers.first_source, file_names: list[str] | None = None) -> DataFrame:
        """Answers with citations; they join the history."""
        said = answers.answer(questions, self.search(questions, file_names), model)
        rows = said.select("question", "answer", F.to_json("citations").alias("citations"), F.current_timestamp().alias("created_at"))
        part, old = self.part("history", rows), self.manifest()
        self.commit(old, {"history": [*old["tables"].get("history", []), part]})
        return said

    def history(self, limit: int = 50) -> DataFrame:
        return self.table("history").orderBy(F.desc("created_at"), "question").limit(limit)

    def search_history(self, questions: DataFrame, k: int = 20) -> DataFrame:
        rows = self.table("history").select(F.xxhash64("question", "created_at").alias("chunk_id"), F.col("question").alias("text"), "answer")
        return fulltext.trigram_topk(rows, questions, k).join(rows, "chunk_id")

    def clear_history(self) -> None:
        self.commit(self.manifest(), {"history": []})

    def toggle_favorites(self, toggles: DataFrame) -> None:
        self.save("favorites", catalog.toggle_favorites(self.table("favorites"), toggles, F.current_timestamp()))

    def favorites(self) -> DataFrame:
        return catalog.favorite_files(self.table("files"), self.table("favorites")).orderBy(F.desc("favorite_at"))

    def files(self, status: str | None = None) -> DataFrame:
        return catalog.by_status(self.table("files"), status).orderBy(F.desc("updated_at"), "id")

    def progress(self) -> DataFrame:
        """``(status, files, chunks)``: how far the files of the catalogue have come."""
        return self.table("files").groupBy("status").agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"))

    def recover(self) -> None:
        """After a crash: what was being processed is taken up again by the next ingest."""
        self.save("files", catalog.reset_processing(self.table("files"), F.current_timestamp()))

    def summarize(self, file_ids: list[int], model=None) -> DataFrame:
        of = self.manifest()
        chosen = self.table("files", of).where(F.col("id").isin(*file_ids))
        return answers.export(answers.summaries(chosen, self.table("chunks", of, file_ids), model))

    def preview(self, file_id: int) -> DataFrame:
        """``(id, file_path, media_type, status, content)`` of a file: ``found`` with its bytes, ``missing`` if its folder
        has it no more. A file that the catalogue lacks gives no row."""
        row = self.table("files").where(F.col("id") == file_id).select("id", "file_path", T.media_type(F.col("file_path")).alias("media_type"))
        known = row.first()
        if known is None or not snapshots.exists(self.spark, known.file_path):
            return row.select("*", F.lit("missing").alias("status"), F.lit(None).cast("binary").alias("content"))
        named = [F.lit(known[c]).alias(c) for c in row.columns]
        return self.spark.read.format("binaryFile").load(known.file_path).select(*named, F.lit("found").alias("status"), "content")
