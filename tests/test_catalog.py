"""Catalogue, cache, fusion, streaming and sources on small tables."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import sys
import time
import zipfile
from pathlib import Path

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from tidemark.operators import catalog, fusion, vectors
from tidemark.sources import files, snapshots
from tidemark.streaming import ingest

REPO = Path(__file__).resolve().parents[1]
def now():
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


FILES = "id long, file_path string, file_name string, file_hash string, status string, total_pages int, is_scanned boolean, tags array<string>, mtime_ns long, chunk_count int, error_msg string, created_at timestamp, updated_at timestamp"


def known(spark):
    rows = [(i, f"/{n}", n, "h", status, 1, False, [], mtime, 3, "bad", None, None) for i, (n, status, mtime) in enumerate([("a", "done", 10), ("b", "error", 10), ("c", "processing", 10), ("d", "pending", 10), ("e", "done", 0)], 1)]
    return spark.createDataFrame(rows, FILES)


def test_what_needs_ingest(spark):
    listing = spark.createDataFrame([("/a", 10, b"x"), ("/b", 5, b"x"), ("/c", 5, b"x"), ("/d", 11, b"x"), ("/e", 1, b"x"), ("/new", 1, b"x")], "file_path string, mtime_ns long, content binary")
    got = {r.file_path: (r.need, r.file_hash is not None) for r in catalog.needs_ingest(listing, known(spark)).collect()}
    assert got == {"/a": (False, False), "/b": (True, False), "/c": (True, False), "/d": (True, True), "/e": (True, True), "/new": (True, False)}


def test_upsert_keeps_id_and_chunk_count(spark):
    given = spark.createDataFrame([("/b", "B", "h2", "done", 2, True, ["t"], 20), ("/z", "Z", "h", "done", 1, False, [], 1), ("/y", "Y", "h", "done", 1, False, [], 1)], "file_path string, file_name string, file_hash string, status string, total_pages int, is_scanned boolean, tags array<string>, mtime_ns long")
    got = {r.file_path: r for r in catalog.upsert_files(known(spark), given, now()).collect()}
    assert (got["/b"].id, got["/b"].chunk_count, got["/b"].error_msg, got["/b"].file_hash) == (2, 3, "", "h2")
    assert {got["/y"].id, got["/z"].id} == {6, 7} and got["/a"].file_hash == "h" and len(got) == 7


def test_reset_and_status(spark):
    got = {r.file_path: (r.status, r.error_msg) for r in catalog.reset_processing(known(spark), now()).collect()}
    assert got["/c"] == ("error", catalog.INTERRUPTED) and got["/a"] == ("done", "bad")
    change = spark.createDataFrame([("/a", "error", None)], "file_path string, status string, error_msg string")
    assert {r.file_path: (r.status, r.error_msg) for r in catalog.set_status(known(spark), change, now()).collect()}["/a"] == ("error", "")


def test_replacing_chunks(spark):
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (9, 3)], "id long, file_id long")
    given = spark.createDataFrame([(1, 0), (1, 1)], "file_id long, position int")
    touched = spark.createDataFrame([(1,), (2,)], "file_id long")
    got = sorted((r.file_id, r.id) for r in catalog.replace_chunks(chunks, given, touched).collect())
    assert [f for f, _ in got] == [1, 1, 3] and sorted(i for _, i in got) == [9, 10, 11]


def test_new_ids_follow_the_order(spark):
    keys = [f"{i * 7919 % 1000:04d}" for i in range(1000)]
    rows = spark.createDataFrame([(k,) for k in keys], "at string").repartition(5)
    after = spark.createDataFrame([(500,)], "last long")
    got = [(r.at, r.id) for r in catalog.new_ids(rows, "at", after).orderBy("id").collect()]
    assert got == [(k, 501 + i) for i, k in enumerate(sorted(keys))]
    assert catalog.new_ids(rows.limit(0), "at", after).collect() == []


def test_new_chunks_are_numbered_by_file_and_position(spark):
    chunks = spark.createDataFrame([(7, 1, 0), (8, 2, 0)], "id long, file_id long, position int")
    given = spark.createDataFrame([(f, p) for f in (12, 3, 100) for p in range(60)], "file_id long, position int").repartition(4)
    touched = given.select("file_id").distinct()
    new = [(r.file_id, r.position) for r in catalog.replace_chunks(chunks, given, touched).where("id > 8").orderBy("id").collect()]
    assert new == [(f, p) for f in (3, 12, 100) for p in range(60)]
    sample = catalog.chunk_sample(catalog.replace_chunks(chunks, given, touched).withColumn("page_num", F.lit(1)).where("file_id = 12"))
    assert [(r.position, r["rank"]) for r in sample.orderBy("rank").collect()] == [(i, i) for i in range(15)]


def test_costs_are_shared_by_chunks(spark):
    batch = spark.createDataFrame([("a", "x", 1), ("b", "x", 3), ("c", None, 2), ("d", "y", 0)], "name string, batch string, chunks long")
    got = {r.name: r.embed_s for r in catalog.attributed_cost(batch, 8.0, "batch").collect()}
    assert got == {"a": 2.0, "b": 6.0, "c": 8.0, "d": 0.0}


def test_deleted_files_cascade(spark):
    chunks = spark.createDataFrame([(1, 1, 11), (2, 1, 12), (3, 2, 13)], "id long, file_id long, vector_id long")
    gone = catalog.deleted_files(known(spark), spark.createDataFrame([("/b",), ("/c",), ("/d",), ("/e",)], "file_path string"), chunks)
    assert [(r.id, r.vector_ids) for r in gone.collect()] == [(1, [11, 12])]
    assert [r.id for r in catalog.without(chunks, gone).collect()] == [3]


def test_toggles(spark):
    have = spark.createDataFrame([(1,), (2,)], "file_id long").withColumn("created_at", now())
    toggles = spark.createDataFrame([(1,), (3,), (2,), (2,)], "file_id long")
    assert sorted(r.file_id for r in catalog.toggle_favorites(have, toggles, now()).collect()) == [2, 3]


def test_cache_encodes_each_text_once(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "")], "chunk_id long, text string")
    cache = spark.createDataFrame([], "model_name string, text_hash string, vector array<float>")
    first, gained = vectors.encode_with_cache(chunks, cache, "torch::m")
    assert first.count() == 4 and gained.count() == 3
    assert tuple(vectors.cache_counts(vectors.cache_plan(chunks, gained, "torch::m")).first()) == (4, 0, 0)
    assert tuple(vectors.cache_counts(vectors.cache_plan(chunks, gained, "other")).first()) == (0, 4, 3)
    assert vectors.encoder_key("onnx", "m", "cpu", "o2", "q8") == "onnx::m::cpu::opt=o2::quant=q8"


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank long")


def test_fusion_prefers_what_both_lists_hold(spark):
    asked = fusion.route(spark.createDataFrame([(1, "short one")], "query_id long, question string"))
    v, k = hits(spark, [(1, 10, 0.9, 0), (1, 11, 0.3, 1)]), hits(spark, [(1, 12, 5.0, 0), (1, 10, 4.0, 1), (1, 11, 3.0, 2)])
    fused = fusion.rrf(v, k, asked)
    order = [r.chunk_id for r in fusion.first(fused).orderBy("rank").collect()]
    assert order == [10, 11, 12]
    assert {r.chunk_id for r in fusion.over_threshold(fused).collect()} == {10, 12}
    kinds = spark.createDataFrame([(12, "table"), (10, "text"), (11, "text")], "chunk_id long, chunk_type string")
    boosted = fusion.rrf(v, k, asked.withColumn("prefer_tables", F.lit(True)), kinds)
    assert {r.chunk_id: r.rrf_score for r in boosted.collect()}[12] == pytest.approx(1.5 / 61, abs=1e-8)


def test_citations_take_the_best_of_a_file(spark):
    rows = [(1, 0, "a", "/a", 1, "x", 0.5), (1, 1, "b", "/b", 1, "y", 0.4), (1, 2, "a", "/a", 2, "z", 0.6)]
    df = spark.createDataFrame(rows, "query_id long, rank long, file_name string, file_path string, page_num int, text string, rerank_score double").withColumn("rrf_score", F.lit(0.1))
    got = [(r.position, r.file_path, r.page_num, r.score) for r in fusion.citations(df).orderBy("position").collect()]
    assert got == [(0, "/a", 2, 0.6), (1, "/b", 1, 0.4)]
    assert fusion.contexts(df.withColumn("section", F.lit("S"))).first().context.startswith("[片段1] 来源: a, 第1页 > S\nx\n\n---\n\n[片段2]")


def test_top_k_blocks_do_not_change_the_answer(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    asked = df.where("chunk_id < 30").withColumnRenamed("chunk_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {q: np.lexsort((np.arange(300), -np.round(unit @ unit[q], 6)))[:5].tolist() for q in range(30)}
    for block in (4096, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {}
        for r in vectors.topk(df, asked, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_throttle_in_batch_and_stream(spark, tmp_path):
    rows = [(1, "p", 0.0), (2, "p", 2.0), (3, "p", 3.5), (4, "p", 6.0), (5, "p", 6.5), (6, "q", 1.0), (7, None, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, path string, at double")
    assert sorted(r.event_id for r in ingest.throttle(df).collect()) == [1, 3, 5, 6]
    df.where("path is not null").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = ingest.throttle_stream(stream).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("throttled").collect()) == [1, 3, 5, 6]


def test_a_tracked_path_is_taken_once(spark, tmp_path):
    rows = [(1, "p", 0.0, False), (2, "p", 1.0, False), (3, "p", 2.0, True), (4, "p", 3.0, False), (5, "p", 3.0, False), (6, "q", 1.0, True), (7, "q", 2.0, False), (8, None, 1.0, False)]
    df = spark.createDataFrame(rows, "event_id long, path string, at double, done boolean")
    got = {r.event_id: r.accepted for r in ingest.once_while_tracked(df).collect()}
    assert got == {1: True, 2: False, 4: True, 5: False, 7: True, 8: False}
    for i, part in enumerate((df.where("event_id < 4"), df.where("event_id >= 4 and path is not null"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = ingest.tracked_stream(stream).writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("tracked").collect()) == [1, 4, 7]


def test_headings_by_font(spark):
    rows = [(1, 1, 2, "Title", 20.0, False), (1, 1, 1, "The ", 10.0, False), (1, 2, 1, "text", 10.0, False), (1, 3, 1, "Bold", 10.0, True), (1, 4, 1, "The Title", 12.0, None), (1, 5, 1, "  ", 30.0, True), (1, 6, 1, "more", 10.0, False), (2, 1, 1, "plain", 9.0, False)]
    df = spark.createDataFrame(rows, "page_id long, line_no int, span_no int, text string, size double, bold boolean").repartition(3)
    assert {r.page_id: r.headings for r in files.font_headings(df).collect()} == {1: ["The Title", "Bold"], 2: []}


def test_micro_batches(spark):
    df = spark.createDataFrame([("q", i, n) for i, n in enumerate([200, 1, 100, 27, 1, 1, 1, 1, 1, 1, 1, 1, 1])], "queue string, position long, chunks long")
    assert [r.batch for r in ingest.micro_batches(df).orderBy("position").collect()] == [0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3]


def stub_judge():
    """Made here, so that workers get it whole: they do not import this file."""

    class StubJudge:
        """Says yes to documents that hold the question's word, and remembers how it was asked."""

        def prompt(self, system, user):
            return [ord(c) for c in f"{system}|{user}"]

        def logits(self, ids):
            out = []
            for said in ("".join(map(chr, i)) for i in ids):
                assert said.startswith(fusion.SYSTEM + "|<Instruct>: Find it.\n<Query>: ") and len(ids) <= 3
                query, document = said.split("<Query>: ")[1].split("\n<Document>: ")
                out.append((2.0, 0.0) if query and query in document else (0.0, 900.0))
            return out

    return StubJudge


def test_a_model_judges(spark, tmp_path):
    loads, judge = str(tmp_path / "loads"), stub_judge()

    def load():
        import tempfile

        os.makedirs(loads, exist_ok=True)
        tempfile.mkstemp(dir=loads, prefix=f"{os.getpid()}-")
        return judge()

    questions = spark.createDataFrame([(1, "tin"), (2, "zinc"), (3, None)], "query_id long, question string")
    rows = [(q, i, t, i) for q in (1, 2, 3) for i, t in enumerate(["tin is soft", "zinc is not", None, "x" * 5000 + " tin", "tin and zinc"])]
    candidates = spark.createDataFrame(rows, "query_id long, chunk_id long, text string, rank long").repartition(3)
    scored = fusion.judged(candidates, questions, load, "stub", "Find it.", most_tokens=2000, together=3)
    got = {q: [r.chunk_id for r in fusion.best_scored(scored).where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    # What stands behind the budget of tokens is not seen; what is under a tenth of the best goes.
    assert got == {1: [0, 4], 2: [1, 4], 3: [0, 1, 2, 3, 4]}
    pids = [n.split("-")[0] for n in os.listdir(loads)]
    assert len(pids) == len(set(pids)) > 0


def test_a_search_can_be_given_up(spark):
    class Slow(stub_judge()):
        def logits(self, ids):
            time.sleep(120)

    questions = spark.createDataFrame([(1, "tin")], "query_id long, question string")
    candidates = spark.createDataFrame([(1, 1, "tin", 0)], "query_id long, chunk_id long, text string, rank long")
    scored = fusion.judged(candidates, questions, Slow, "slow", "Find it.")
    failed, began = [], time.time()

    def ask():
        spark.sparkContext.addJobTag("a search")
        try:
            failed.append(scored.collect())
        except Exception as e:  # noqa: BLE001  whatever says that the job was cancelled
            failed.append(e)

    asked = InheritableThread(target=ask, session=spark)
    asked.start()
    while asked.is_alive() and time.time() - began < 40:
        time.sleep(1)
        spark.sparkContext.cancelJobsWithTag("a search")
    asked.join(5)
    assert failed and isinstance(failed[0], Exception)


def test_manifests(spark, tmp_path):
    root = str(tmp_path / "t")
    empty = snapshots.manifest(spark, root)
    assert empty["version"] == 0 and snapshots.read(spark, root, "x", "a long", empty).count() == 0
    first, known = snapshots.part(spark.range(3).toDF("a"), root, "x", ranges=["a"])
    assert known == {"schema": 1, "rows": 3, "low a": 0, "high a": 2}
    one = snapshots.commit(spark, root, empty, {"x": [first]})
    second = snapshots.part(spark.range(2).toDF("a").withColumn("b", F.lit("s")), root, "x")[0]
    assert snapshots.read(spark, root, "x", "a long", snapshots.manifest(spark, root)).count() == 3  # not named yet
    two = snapshots.commit(spark, root, one, {"x": [first, second]}, {"k": 1})
    assert snapshots.manifest(spark, root) == two and snapshots.manifest(spark, root, 1) == one
    got = [(r.a, r.b) for r in snapshots.read(spark, root, "x", "a long, b string", two).collect()]
    assert sorted(got, key=repr) == [(0, "s"), (0, None), (1, "s"), (1, None), (2, None)]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, one, {"x": []})
    (tmp_path / "t" / "manifests" / "m3.json").write_text('{"version": 3, "tab')  # a writer that broke off
    assert snapshots.manifest(spark, root) == two
    assert snapshots.commit(spark, root, two, {"x": [second]})["version"] == 4
    assert snapshots.unnamed(spark, root) == [first]
    snapshots.remove(spark, root, [first])
    assert snapshots.unnamed(spark, root) == []


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    """However two commits interleave, the one that is refused knows, and no part of the other is lost."""
    root = str(tmp_path / "t")
    parts = [snapshots.part(spark.range(i + 1).toDF("a"), root, "x")[0] for i in range(3)]
    one = snapshots.commit(spark, root, snapshots.manifest(spark, root), {"x": parts[:1]})
    publish, others = snapshots._publish, []

    def after_another(*args):
        """The other writer's whole commit falls between this one's writing and its naming."""
        if not others:
            others.append(None)
            others[0] = snapshots.commit(spark, root, one, {"x": parts[:2]})
        return publish(*args)

    monkeypatch.setattr(snapshots, "_publish", after_another)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, one, {"x": [parts[0], parts[2]]})
    assert snapshots.manifest(spark, root) == others[0] and others[0]["tables"] == {"x": parts[:2]}
    again = snapshots.commit(spark, root, snapshots.manifest(spark, root), {"x": parts})
    assert again["version"] == 3 and [p.name for p in (tmp_path / "t" / "manifests").iterdir() if p.suffix != ".crc" and not p.name.startswith("m")] == []


def test_parts_of_older_schemas_have_defaults(spark, tmp_path):
    root = str(tmp_path / "t")
    changes = (snapshots.Change(2, "x", "b", "'none'"), snapshots.Change(3, "x", "c", "a * 10"), snapshots.Change(2, "y", "a", "0"))
    rows = [spark.sql("select 1 as a"), spark.sql("select 2 as a, 'two' as b"), spark.sql("select 3L as a, 'three' as b, 7L as c")]
    parts = dict(snapshots.part(df, root, "x", i) for i, df in enumerate(rows, 1))
    now = snapshots.commit(spark, root, snapshots.manifest(spark, root), {"x": list(parts)}, parts=parts)
    got = snapshots.read(spark, root, "x", "a long, b string, c long", now, changes=changes)
    assert sorted(map(tuple, got.collect())) == [(1, "none", 10), (2, "two", 20), (3, "three", 7)]
    # Of parts that are older than what is known of parts, nothing is known: they count as the first schema.
    assert sorted(map(tuple, snapshots.read(spark, root, "x", "a long, b string", now | {"parts": {}}, changes=changes[:1]).collect())) == [(1, "none"), (2, "none"), (3, "none")]


def test_a_lookup_reads_few_parts(spark, tmp_path):
    root, parts = str(tmp_path / "t"), {}
    for i in range(24):
        parts |= dict([snapshots.part(spark.createDataFrame([(i, f"run-{i}"), (i + 100, f"run-{i}")], "file_id long, run string"), root, "x", ranges=["file_id", "run"])])
    now = snapshots.commit(spark, root, snapshots.manifest(spark, root), {"x": list(parts)}, parts=parts)
    files = lambda df: {f.split("/")[-2] for f in df.inputFiles()}
    every = snapshots.read(spark, root, "x", "file_id long, run string", now)
    few = snapshots.read(spark, root, "x", "file_id long, run string", now, [{"file_id": 5, "run": "run-5"}, {"file_id": 107, "run": "run-7"}])
    assert (len(files(every)), len(files(few)), few.count()) == (24, 2, 4)
    assert snapshots.read(spark, root, "x", "file_id long, run string", now, [{"file_id": 5, "run": "run-6"}]).count() == 0
    assert [len(g) for g in snapshots.like_sized(now, "x", 8)] == [24] and snapshots.like_sized(now, "x", 30) == []


def test_files_to_pages(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "sub" / "b.md").write_text("Text #tag [[x|y]]")
    (tmp_path / "c.docx").write_bytes(buffer.getvalue())
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.py").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.pages(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.TXT", "b.md", "c.docx", "d.docx", "e.pdf"}
    assert got["a.TXT"].text == "café �" and (got["b.md"].text, got["b.md"].tags) == ("Text #tag y", ["tag"])
    assert got["c.docx"].text == "Hello\na | b" and got["d.docx"].status == "error" and got["e.pdf"].status == "unsupported"
    pdf = files.pages(files.scan(spark, str(tmp_path), suffixes=[".pdf"]), {".pdf": lambda b: ["", "page two"]})
    assert [(r.page_num, r.text) for r in pdf.orderBy("page_num").collect()] == [(1, ""), (2, "page two")]
    assert files.is_scanned(pdf).first().is_scanned


def test_the_library_stands_without_its_optional_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout) > 50
