"""Streams with state and timers: each against its batch twin, and files from a folder to the library."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.plans.library import Library
from tidemark.sources.files import Watch
from tidemark.streaming import ingest, watch


def run(stream, folder, **trigger):
    """What a stream gives, and the states that it held after each micro-batch."""
    held, rows = [], []

    def keep(batch, number):
        rows.extend(tuple(r) for r in batch.collect())

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(folder)).trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        query.awaitTermination()
        held = [[s["numRowsTotal"] for s in json.loads(p.json)["stateOperators"]] for p in query.recentProgress]
    return query, rows, held


def as_stream(spark, df, folder, files):
    """Rows by ``part`` in files that a stream takes one at a time, in this order."""
    for i in range(files):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/in/{i}")
        now = time.time() - 1000 + i
        for name in os.listdir(f"{folder}/in/{i}"):
            os.utime(f"{folder}/in/{i}/{name}", (now, now))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_throttle_forgets_what_it_needs_no_more(spark, tmp_path):
    rows = [(i, f"p{i % 5}", 1.0 + i * 0.7, i // 40) for i in range(200)] + [(900, None, 5.0, 0), (901, "p1", None, 1), (902, "other", 1000.0, 5), (903, "late comer", 2000.0, 6), (904, "last", 3000.0, 7)]
    df = spark.createDataFrame(rows, "event_id long, path string, at double, part int")
    _, got, held = run(ingest.throttle_stream(as_stream(spark, df, tmp_path, 8), 3.0, "5 seconds"), tmp_path / "state")
    assert sorted(got) == sorted(tuple(r) for r in ingest.throttle(df.drop("part"), 3.0).collect())
    assert max(h[0] for h in held) >= 5 and held[-1][0] < 5


def test_tracked_paths_leave_when_done(spark, tmp_path):
    rows = [(1, "a", 1.0, False, 0), (2, "a", 2.0, False, 0), (3, "b", 2.0, False, 0), (4, "a", 3.0, True, 1), (5, "a", 4.0, False, 1), (6, None, 4.0, False, 1), (7, "c", 5.0, True, 1), (8, "b", 6.0, True, 2), (9, "a", 7.0, True, 2), (10, "b", 8.0, False, 3), (11, "b", 8.0, False, 3), (12, "b", 9.0, True, 3)]
    df = spark.createDataFrame(rows, "event_id long, path string, at double, done boolean, part int")
    _, got, held = run(ingest.tracked_stream(as_stream(spark, df, tmp_path, 4)), tmp_path / "state")
    want = ingest.once_while_tracked(df.drop("part")).where("accepted").select("event_id", "path", "at")
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) == 4
    assert max(h[0] for h in held) > held[-1][0]


def test_tracked_paths_are_forgotten(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0, False, 0), (2, "a", 2.0, False, 1)], "event_id long, path string, at double, done boolean, part int")
    stream = ingest.tracked_stream(as_stream(spark, df, tmp_path, 2), forget_s=0.001)
    query, got, _ = run(stream, tmp_path / "state", processingTime="200 milliseconds")
    try:
        until = time.time() + 60
        while len(got) < 2 and time.time() < until and query.isActive:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [r[0] for r in got] == [1, 2]


def test_batches_are_flushed_when_full_or_old(spark, tmp_path):
    rows = [(q, i, n, 0) for q, sizes in (("x", [100, 20, 9, 300, 1, 1, 1, 1, 1, 1, 1, 1, 1]), ("y", [5, 5]), ("z", [128])) for i, n in enumerate(sizes)] + [(None, 1, 1, 0), ("x", None, 1, 0)]
    df = spark.createDataFrame(rows, "queue string, position long, chunks long, part int")
    stream = ingest.micro_batch_stream(as_stream(spark, df, tmp_path, 1), linger_s=0.3)
    query, got, _ = run(stream, tmp_path / "state", processingTime="200 milliseconds")
    want = sorted(tuple(r) for r in ingest.micro_batches(df.drop("part").dropna()).collect())

    def wait(n):
        until = time.time() + 90
        while len(got) < n and time.time() < until and query.isActive:
            time.sleep(0.2)
        assert len(got) == n, query.exception()

    try:
        # No more files come: what isn't full comes out all the same.
        wait(len(want))
        assert sorted(got) == want
        # What comes after a batch was flushed is in the next one, though the last was not full.
        df.sparkSession.createDataFrame([("y", 7, 5)], "queue string, position long, chunks long").coalesce(1).write.parquet(str(tmp_path / "in" / "later"))
        wait(len(want) + 1)
        assert got[-1] == ("y", 7, 5, 1)
    finally:
        query.stop()


def test_changes_of_listings(spark):
    listing = spark.sql("select * from values ('a', timestamp'2024-01-01', 1L), ('b', timestamp'2024-01-02', 1L), ('c', timestamp'2024-01-01', 2L), ('d', null, 1L), (null, timestamp'2024-01-01', 1L) as t(path, modified, length)")
    before = spark.sql("select * from values ('a', timestamp'2024-01-01', 1L), ('b', timestamp'2024-01-01', 1L), ('c', timestamp'2024-01-01', 1L), ('d', null, 1L), ('gone', null, 1L) as t(path, modified, length)")
    assert sorted(map(tuple, watch.changes(listing, before).collect())) == [("b", "modified"), ("c", "modified")]
    assert sorted(map(tuple, watch.changes(listing, before.limit(0)).collect())) == [(p, "created") for p in "abcd"]


def test_files_from_a_folder_to_the_library(spark, tmp_path):
    """Two polls, a file rewritten between them, a restart, and a poll that finds nothing."""
    folder, lib = tmp_path / "in", Library(spark, str(tmp_path / "lib"))
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("Alpha text.")
    (folder / "sub" / "b.md").write_text("Beta text.")
    (folder / "c.exe").write_text("no text")
    seen = watch.FileWatch(spark, [Watch(str(folder))], str(tmp_path / "watch"))
    texts = lambda: sorted(r.text for r in lib.payload().collect())
    assert seen.poll() == 2 and seen.poll() == 0
    lib.follow(seen, seconds=0.0).awaitTermination()
    assert texts() == ["Alpha text.", "Beta text."]
    (folder / "a.txt").write_text("Alpha has changed.")
    later = os.path.getmtime(folder / "a.txt") + 10
    os.utime(folder / "a.txt", (later, later))
    (folder / "d.txt").write_text("Delta text.")
    # Another object over the same state goes on.
    seen = watch.FileWatch(spark, [Watch(str(folder))], str(tmp_path / "watch"))
    assert seen.poll() == 2
    lib.follow(seen, seconds=0.0).awaitTermination()
    assert texts() == ["Alpha has changed.", "Beta text.", "Delta text."]
    events = spark.read.schema(watch.EVENTS).parquet(str(tmp_path / "watch" / "events"))
    kinds = sorted((r.path.rsplit("/", 1)[1], r.kind) for r in events.collect())
    assert kinds == [("a.txt", "created"), ("a.txt", "done"), ("a.txt", "done"), ("a.txt", "modified"), ("b.md", "created"), ("b.md", "done"), ("d.txt", "created"), ("d.txt", "done")]
    assert len(lib.manifest()["tables"]["chunks"]) == 2


def test_a_poll_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Alpha text.")
    seen = watch.FileWatch(spark, [Watch(str(folder))], str(tmp_path / "watch"))
    write = watch.FileWatch._write

    def breaks(self, df, name):
        if name.startswith("listings"):
            raise OSError("the disk is full")
        return write(self, df, name)

    monkeypatch.setattr(watch.FileWatch, "_write", breaks)
    with pytest.raises(OSError):
        seen.poll()
    monkeypatch.setattr(watch.FileWatch, "_write", write)
    assert seen.poll() == 1 and seen.poll() == 0


def test_polls_run_by_themselves(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = watch.FileWatch(spark, [Watch(str(folder))], str(tmp_path / "watch"))
    query = seen.start("500 milliseconds")
    try:
        (folder / "a.txt").write_text("Alpha text.")
        until = time.time() + 60
        while time.time() < until and query.isActive and not os.path.exists(tmp_path / "watch" / "events"):
            time.sleep(0.2)
        time.sleep(1)
    finally:
        query.stop()
    assert [r.kind for r in spark.read.schema(watch.EVENTS).parquet(str(tmp_path / "watch" / "events")).collect()] == ["created"]
