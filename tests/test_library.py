"""A library from files to answers, twice over."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fulltext, vectors
from tidemark.plans.library import Library
from tidemark.sources import snapshots
from tidemark.sources.files import Watch


def test_from_files_to_answers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "cats.md").write_text("# Cats\nCats sleep most of the day. They purr.\n\n| Name | Age |\n|---|---|\n| Tom | 3 |\n#pets")
    (folder / "rust.txt").write_text("Rust is iron oxide, and forms when iron meets water and air.")
    (folder / "scan.pdf").write_bytes(b"%PDF")
    lib = Library(spark, str(tmp_path / "lib"), threshold=0.0)
    first = {r.file_path.rsplit("/", 1)[1]: (r.status, r.chunk_count) for r in lib.ingest(str(folder)).collect()}
    assert first == {"cats.md": ("done", 4), "rust.txt": ("done", 1), "scan.pdf": ("unsupported", 0)}
    assert lib.ingest(str(folder)).count() == 0
    asked = spark.createDataFrame([(1, "what does iron form with water"), (2, "zzzzzz qqqqqq")], "query_id long, question string")
    hits = lib.search(asked).where("query_id = 1").orderBy("rank").collect()
    assert hits[0].file_name == "rust.txt"
    assert lib.search(asked, ["cats.md"]).where("file_name = 'rust.txt'").count() == 0
    said = {r.query_id: r for r in lib.ask(asked).collect()}
    assert "iron oxide" in said[1].answer and said[1].citations[0].file_name == "rust.txt"
    assert lib.history().count() == 2
    found = lib.search_history(spark.createDataFrame([(1, "iron form")], "query_id long, question string")).collect()
    assert [r.text for r in found] == ["what does iron form with water"]
    ids = {r.file_name: r.id for r in lib.files().collect()}
    lib.toggle_favorites(spark.createDataFrame([(ids["cats.md"],)], "file_id long"))
    assert [r.file_name for r in lib.favorites().collect()] == ["cats.md"]
    assert lib.summarize([ids["rust.txt"]]).first().markdown.startswith("## rust.txt\n\nRust is")
    seen = lib.preview(ids["rust.txt"]).first()
    assert seen.media_type.startswith("text/plain") and seen.status == "found" and bytes(seen.content).startswith(b"Rust is")
    assert lib.preview(999).count() == 0
    (folder / "rust.txt").write_text("Now about tin.")
    later = os.path.getmtime(folder / "rust.txt") + 10
    os.utime(folder / "rust.txt", (later, later))
    assert [r.chunk_count for r in lib.ingest(str(folder)).collect()] == [1]
    assert {r.file_name: r.id for r in lib.files().collect()} == ids
    (folder / "cats.md").unlink()
    assert tuple(lib.preview(ids["cats.md"]).first())[3:] == ("missing", None)
    assert [r.file_name for r in lib.forget_deleted(str(folder)).collect()] == ["cats.md"]
    assert lib.favorites().count() == 0 and {r.text for r in lib.payload().collect()} == {"Now about tin."}
    lib.clear_history()
    assert lib.history().count() == 0


def folder_of(tmp_path, **texts):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)
    return str(folder)


def state(lib):
    return sorted((r.file_path.rsplit("/", 1)[1], r.chunk_id, r.text) for r in lib.payload().collect())


def keyword_hits(lib, asked):
    """Keyword and substring hits by the kept indexes."""
    hits = fulltext.search(lib.payload(), fulltext.index_of(lib.table("postings"), lib.table("lengths")), asked, grams=lib.table("grams"))
    return sorted((r.query_id, r.file_name, r.path) for r in hits.join(lib.payload().select("chunk_id", "file_name"), "chunk_id").collect())


def test_a_call_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    folder = folder_of(tmp_path, a="Alpha is first.", b="Beta is second.")
    lib = Library(spark, str(tmp_path / "lib"))
    lib.ingest(folder)
    before = state(lib)
    later = os.path.getmtime(f"{folder}/a.txt") + 10
    folder_of(tmp_path, a="Alpha has changed.", c="Gamma is new.")
    os.utime(f"{folder}/a.txt", (later, later))
    for table in ("postings", "vectors", "files"):
        real = Library.part

        def part(self, name, df, table=table, real=real):
            if name == table:
                raise OSError("the disk is full")
            return real(self, name, df)

        monkeypatch.setattr(Library, "part", part)
        with pytest.raises(OSError):
            lib.ingest(folder)
        monkeypatch.setattr(Library, "part", real)
        assert state(lib) == before and lib.files("done").count() == 2
    assert lib.ingest(folder).count() == 2
    after = state(lib)
    assert [(f, t) for f, _, t in after] == [("a.txt", "Alpha has changed."), ("b.txt", "Beta is second."), ("c.txt", "Gamma is new.")]
    lib.compact()
    lib.vacuum()
    assert state(lib) == after
    asked = spark.createDataFrame([(1, "changed"), (2, "first"), (3, "econ")], "query_id long, question string")
    assert keyword_hits(lib, asked) == [(1, "a.txt", "terms"), (3, "b.txt", "substrings")]


def test_summaries_follow_the_file(spark, tmp_path):
    body = "\n\n".join(f"Paragraph {i:03d} " + "filler words " * 60 for i in range(100))
    lib = Library(spark, str(tmp_path / "lib"))
    lib.ingest(folder_of(tmp_path, long=body, other="Something else."))
    row = lib.files().where("file_name = 'long.txt'").first()
    assert row.chunk_count >= 100
    said = lib.summarize([row.id]).first().markdown
    seen = [int(x) for x in re.findall(r"Paragraph (\d+)", said)]
    assert seen == sorted(seen) and seen[0] == 0 and len(set(seen)) in (14, 15, 16)


def test_folders_encoders_and_backfill(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    (two / "sub").mkdir(parents=True)
    one.mkdir()
    (one / "a.txt").write_text("Alpha text.")
    (one / "b.md").write_text("数据统计报告的内容")
    (two / "c.txt").write_text("Gamma text.")
    (two / "sub" / "d.txt").write_text("Delta text.")
    (two / "e.docx").write_bytes(b"broken")
    lib = Library(spark, str(tmp_path / "lib"))
    watches = [Watch(str(one), suffixes=(".md",)), Watch(str(one)), Watch(str(two), recursive=False)]
    got = {r.file_path.rsplit("/", 1)[1]: r.status for r in lib.ingest(watches).collect()}
    assert got == {"a.txt": "done", "b.md": "done", "c.txt": "done", "e.docx": "error"}
    assert "BadZipFile" in lib.files("error").first().error_msg
    assert {r.status: (r.files, r.chunks) for r in lib.progress().collect()} == {"done": (3, 3), "error": (1, 0)}
    asked = spark.createDataFrame([(1, "统计")], "query_id long, question string")
    assert keyword_hits(lib, asked) == [(1, "b.md", "terms")]
    old = lib.manifest()
    snapshots.commit(spark, lib.path, old, {t: [] for t in ("postings", "lengths", "grams")})
    assert keyword_hits(lib, asked) == []
    assert lib.backfill() == 3 and lib.backfill() == 0
    assert keyword_hits(lib, asked) == [(1, "b.md", "terms")]
    other = Library(spark, lib.path, encoder_key="hashed::short", encoder=lambda texts: vectors.encode(texts, 16))
    (two / "f.txt").write_text("Phi text.")
    other.ingest(watches)
    assert {len(r.vector) for r in other.table("vectors").collect()} == {16} and other.table("vectors").count() == 4


def test_a_filter_decides_the_fallback(spark, tmp_path):
    """A question that has keyword hits, but none in the named files, asks for substrings in those."""
    lib = Library(spark, str(tmp_path / "lib"), threshold=0.0)
    lib.ingest(folder_of(tmp_path, a="A quick brown fox.", b="The quickest hare of all.", c="Nothing here."))
    asked = spark.createDataFrame([(1, "quick")], "query_id long, question string")
    payload = lib.payload()
    hits = lambda names: sorted((r.file_name, r.path) for r in fulltext.search(payload, fulltext.index_of(lib.table("postings"), lib.table("lengths")), asked, grams=lib.table("grams"), allowed=F.col("file_name").isin(*names)).join(payload.select("chunk_id", "file_name"), "chunk_id").collect())
    assert hits(["a.txt", "b.txt"]) == [("a.txt", "terms")]
    assert hits(["b.txt"]) == [("b.txt", "substrings")]
    assert hits(["c.txt"]) == []
    assert {r.file_name for r in lib.search(asked, ["b.txt"]).collect()} == {"b.txt"}


def test_parts_grow_and_are_merged(spark, tmp_path, monkeypatch):
    lib = Library(spark, str(tmp_path / "lib"))
    for i in range(3):
        folder = folder_of(tmp_path, **{f"n{i}": f"Text number {i}."})
        lib.ingest(folder)
    before, ids = state(lib), {r.file_name: r.id for r in lib.files().collect()}
    assert len(lib.manifest()["tables"]["chunks"]) == 3
    assert len(lib.table("chunks", file_ids=[ids["n1.txt"]]).inputFiles()) < len(lib.table("chunks").inputFiles())
    assert [r.text for r in lib.table("chunks", file_ids=[ids["n1.txt"]]).collect()] == ["Text number 1."]
    monkeypatch.setattr(snapshots, "FAN", 3)
    lib.compact(everything=False)
    assert len(lib.manifest()["tables"]["chunks"]) == 1 and state(lib) == before
    said = [(r.stage, r.files, r.chunks) for r in lib.stages().where("run = 'run-3'").orderBy("nth").collect()]
    assert said == [("queued", 1, 0), ("preparing", 1, 0), ("embedding", 1, 1), ("storing", 1, 1), ("done", 1, 1)]


def test_stages_of_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    folder, lib = folder_of(tmp_path, a="Alpha.", b="Beta."), Library(spark, str(tmp_path / "lib"))

    def broken(*args):
        raise OSError("no model")

    monkeypatch.setattr(vectors, "encode_with_cache", broken)
    with pytest.raises(OSError):
        lib.ingest(folder)
    last = lib.stages().first()
    assert (last.run, last.stage, last.files, last.chunks) == ("run-1", "embedding", 2, 2) and lib.files().count() == 0


def test_kept_vector_lists(spark, tmp_path):
    """Lists are trained once, later ingests append, and a search finds what a full one does."""
    topics = ["cats purr and sleep", "iron rusts in water", "ships sail at sea", "bread is baked of flour"]
    folder = folder_of(tmp_path, **{f"t{i}": f"{topics[i % 4]} {i} " + " ".join(f"w{i % 4}x{j}" for j in range(i % 7)) for i in range(24)})
    lib = Library(spark, str(tmp_path / "lib"), threshold=0.0)
    lib.ingest(folder)
    asked = spark.createDataFrame(list(enumerate(topics)), "query_id long, question string")
    assert lib.index_vectors(asked) >= 0.9 and lib.manifest()["values"]["recall"] >= 0.9
    parts = lib.manifest()["tables"]["vectors"]
    assert len(parts) == 1
    lib.ingest(folder_of(tmp_path, late="cats purr and sleep late"))
    after = lib.manifest()["tables"]["vectors"]
    assert after[:1] == parts and len(after) == 2 and vectors.NO_LIST not in {r["list"] for r in lib.table("vectors").collect()}
    assert "late.txt" in {r.file_name for r in lib.search(asked).where("query_id = 0").collect()}
