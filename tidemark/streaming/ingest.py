"""Continuous ingest: throttled file events, micro-batches, and a stream that feeds the batch pipeline."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

THROTTLE_S = 3.0
MOST_FILES, MOST_CHUNKS = 8, 128
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def throttle(events: DataFrame, seconds: float = THROTTLE_S) -> DataFrame:
    """``events(event_id, path, at double)`` that are accepted: ``seconds`` or more after the path's last
    accepted one. Rows are folded in a sorted stream, so a busy path costs time but no memory.
    Ties are taken in the order of ``event_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last = None, 0.0
        for batch in batches:
            keep = []
            for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                taken = p != path or t - last >= seconds
                if taken:
                    path, last = p, t
                keep.append(taken)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = events.select(F.col("event_id").cast("long").alias("event_id"), F.col("path").cast("string").alias("path"), F.col("at").cast("double").alias("at"))
    rows = rows.where(F.col("path").isNotNull() & F.col("at").isNotNull())
    return rows.repartition(_partitions(events), "path").sortWithinPartitions("path", "at", "event_id").mapInArrow(run, rows.schema)


def stateful(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB: on the executors' disks, written to the checkpoint, with timers and expiry."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _nothing(columns: str) -> pd.DataFrame:
    types = {"long": "int64", "double": "float64", "string": "object"}
    return pd.DataFrame({c.split()[0]: pd.Series(dtype=types[c.split()[1]]) for c in columns.split(", ")})


def _events(events: DataFrame) -> DataFrame:
    """Events that have a path and a time."""
    return events.where(F.col("path").isNotNull() & F.col("at").isNotNull()).withColumn("at", F.col("at").cast("double"))


#: Seconds that event times are shifted by for the watermark, which starts at 1970: no time counts as late from the start.
SHIFT = 1 << 32
ACCEPTED = "event_id long, path string, at double"


class _Throttle(StatefulProcessor):
    """A path's last accepted time, until no event that it could refuse can come any more."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues):
        last, taken = self.last.get()[0] if self.last.exists() else None, []
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for event_id, at in frame[["event_id", "at"]].itertuples(index=False):
            if last is None or at - last >= self.seconds:
                last = at
                taken.append((event_id, key[0], at))
        if taken:
            self.last.update((last,))
            self.handle.registerTimer(math.ceil((last + self.seconds + SHIFT) * 1000))
        yield pd.DataFrame(taken, columns=["event_id", "path", "at"]) if taken else _nothing(ACCEPTED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and (self.last.get()[0] + self.seconds + SHIFT) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield _nothing(ACCEPTED)

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, seconds: float = THROTTLE_S, late: str = "1 minute") -> DataFrame:
    """The same on a stream: each path's last accepted time is kept as state, and dropped when the watermark has passed
    it by ``seconds``, so state holds the paths of a few seconds. Events that come more than ``late`` after later ones
    are dropped; all others fare as in the batch."""
    stateful(events.sparkSession)
    timed = _events(events).withColumn("_time", F.timestamp_seconds(F.col("at") + SHIFT)).withWatermark("_time", late)
    return timed.groupBy("path").transformWithStateInPandas(_Throttle(seconds), ACCEPTED, "Append", "EventTime")


def once_while_tracked(events: DataFrame) -> DataFrame:
    """``events(event_id, path, at, done)`` that are submissions, with ``accepted``: a path that is queued or in work
    is not taken again until it is done.

    A path is tracked from its first submission after the last event that it is done; ties are taken in the order
    of ``event_id``. A path's events are sorted in one task, which spills. Null paths are never accepted.
    """
    order = Window.partitionBy("path").orderBy("at", "event_id")
    ended = F.count(F.when(F.col("done"), 1)).over(order)
    named = events.withColumn("_ended", ended).where("not done")
    first = F.row_number().over(Window.partitionBy("path", "_ended").orderBy("at", "event_id")) == 1
    return named.withColumn("accepted", first & F.col("path").isNotNull()).drop("_ended")


class _Tracked(StatefulProcessor):
    """Whether a path is tracked: there is state while it is."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "at double", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        was = since = self.since.get()[0] if self.since.exists() else None
        taken = []
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for event_id, at, done in frame[["event_id", "at", "done"]].itertuples(index=False):
            if done:
                since = None
            elif since is None:
                since = at
                taken.append((event_id, key[0], at))
        if since is None and was is not None:
            self.since.clear()
        elif since is not None and since != was:
            self.since.update((since,))
        yield pd.DataFrame(taken, columns=["event_id", "path", "at"]) if taken else _nothing(ACCEPTED)

    def close(self) -> None:
        pass


def tracked_stream(events: DataFrame, forget_s: float | None = None) -> DataFrame:
    """The accepted submissions of a stream: state holds the paths that are queued or in work. Null paths are never
    accepted. With ``forget_s`` a path that nothing has finished in so much processing time can be submitted again;
    such a query looks at the clock and so runs until it is stopped."""
    stateful(events.sparkSession)
    mode = "None" if forget_s is None else "ProcessingTime"
    return _events(events).groupBy("path").transformWithStateInPandas(_Tracked(forget_s and round(forget_s * 1000)), ACCEPTED, "Append", mode)


def micro_batches(prepared: DataFrame, most_files: int = MOST_FILES, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """``prepared(queue, position, chunks)`` with ``batch``: files in order, until a batch has ``most_files`` or
    ``most_chunks``, or the next file would lift it over ``most_chunks``; a batch's first file always fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, number, files, chunks = None, 0, 0, 0
        for batch in batches:
            out = []
            for q, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if q != queue:
                    queue, number, files, chunks = q, 0, 0, 0
                elif files >= most_files or chunks >= most_chunks or chunks + n > most_chunks:
                    number, files, chunks = number + 1, 0, 0
                files, chunks = files + 1, chunks + n
                out.append(number)
            yield batch.append_column("batch", pa.array(out, pa.int64()))

    rows = prepared.select(F.col("queue").cast("string").alias("queue"), F.col("position").cast("long").alias("position"), F.col("chunks").cast("long").alias("chunks"))
    return rows.repartition(_partitions(prepared), "queue").sortWithinPartitions("queue", "position").mapInArrow(run, "queue string, position long, chunks long, batch long")


PACKED = "queue string, position long, chunks long, batch long"
LINGER_S = 0.075


class _Packer(StatefulProcessor):
    """The open batch of a queue, and its number."""

    def __init__(self, most_files: int, most_chunks: int, linger_ms: int):
        self.most_files, self.most_chunks, self.linger_ms = most_files, most_chunks, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.number = handle, handle.getValueState("number", "batch long")
        self.open, self.since = handle.getListState("open", "position long, chunks long"), handle.getValueState("since", "ms long")

    def packed(self, queue: str, number: int, files: list) -> list:
        return [(queue, position, chunks, number) for position, chunks in files]

    def handleInputRows(self, key, rows, timerValues):
        number = self.number.get()[0] if self.number.exists() else 0
        files, out, opened = [tuple(f) for f in self.open.get()], [], False
        frame = pd.concat(list(rows)).sort_values("position")
        for position, chunks in frame[["position", "chunks"]].itertuples(index=False):
            total = sum(n for _, n in files)
            if files and (len(files) >= self.most_files or total >= self.most_chunks or total + chunks > self.most_chunks):
                out += self.packed(key[0], number, files)
                files, number = [], number + 1
            opened |= not files
            files.append((int(position), int(chunks)))
        if len(files) >= self.most_files or sum(n for _, n in files) >= self.most_chunks:
            out += self.packed(key[0], number, files)
            files, number = [], number + 1
        self.number.update((number,))
        if not files:
            self.open.clear()
            self.since.clear()
        else:
            self.open.put(files)
            if opened:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.since.update((now,))
                self.handle.registerTimer(now + self.linger_ms)
        yield pd.DataFrame(out, columns=["queue", "position", "chunks", "batch"]) if out else _nothing(PACKED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        # A timer of a batch that was full before it ran out says nothing of the next one.
        if self.since.exists() and self.since.get()[0] + self.linger_ms <= expiredTimerInfo.getExpiryTimeInMs():
            number = self.number.get()[0]
            out = self.packed(key[0], number, [tuple(f) for f in self.open.get()])
            self.number.update((number + 1,))
            self.open.clear()
            self.since.clear()
        yield pd.DataFrame(out, columns=["queue", "position", "chunks", "batch"]) if out else _nothing(PACKED)

    def close(self) -> None:
        pass


def micro_batch_stream(prepared: DataFrame, most_files: int = MOST_FILES, most_chunks: int = MOST_CHUNKS, linger_s: float = LINGER_S) -> DataFrame:
    """``micro_batches`` of a stream: a batch comes out when it is full, or ``linger_s`` (processing time) after its first
    file came. State is a queue's open batch, ``most_files`` at most, and its number; rows without a queue, a position
    or a number of chunks are dropped."""
    stateful(prepared.sparkSession)
    rows = prepared.select(F.col("queue").cast("string").alias("queue"), F.col("position").cast("long").alias("position"), F.col("chunks").cast("long").alias("chunks")).dropna()
    return rows.groupBy("queue").transformWithStateInPandas(_Packer(most_files, most_chunks, round(linger_s * 1000)), PACKED, "Append", "ProcessingTime")


def run_available(stream: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feed what the source holds to ``ingest(batch, number)`` and stop; a rerun takes up where it ended."""
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
