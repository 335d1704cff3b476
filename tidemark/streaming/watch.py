"""File events as a stream: listings of the watched folders, one after another, and what has changed between them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import files as source
from tidemark.sources import snapshots
from tidemark.streaming import ingest

LISTED = "path string, modified timestamp, length long"
EVENTS = "event_id long, path string, kind string, at double"


def changes(listing: DataFrame, before: DataFrame) -> DataFrame:
    """``(path, kind)`` of the files of ``listing(path, modified, length)`` that were not listed before (created), or
    with another time or length (modified). Files that are gone are no event; null paths are none either."""
    old = before.select("path", F.col("modified").alias("old_modified"), F.col("length").alias("old_length"), F.lit(True).alias("known"))
    joined = listing.where("path is not null").join(old, "path", "left")
    same = F.col("modified").eqNullSafe(F.col("old_modified")) & F.col("length").eqNullSafe(F.col("old_length"))
    kind = F.when(F.col("known").isNull(), "created").when(~same, "modified")
    return joined.select("path", kind.alias("kind")).where("kind is not null")


@dataclass
class FileWatch:
    """Watches folders. Everything it knows is in tables under ``state``, so that it goes on where it was.

    ``poll`` lists the folders by Spark (on any storage that it reads, names and times only), writes the events since
    the last listing, and then the listing: a poll that breaks off is done again, and an event may then come twice but
    is never lost. ``events`` is the stream of them all.
    """

    spark: SparkSession
    watches: list[source.Watch]
    state: str

    def _numbers(self) -> list[int]:
        """Numbers of the listings that are whole."""
        fs, folder = snapshots._fs(self.spark, self.state), snapshots._path(self.spark, f"{self.state}/listings")
        if not fs.exists(folder):
            return []
        whole = [s.getPath() for s in fs.listStatus(folder) if fs.exists(snapshots._path(self.spark, f"{s.getPath()}/_SUCCESS"))]
        return sorted(int(p.getName()) for p in whole)

    def _listing(self, number: int) -> DataFrame:
        return self.spark.read.schema(LISTED).parquet(f"{self.state}/listings/{number:08d}")

    def poll(self) -> int:
        """List the folders and write what has changed; returns the number of events."""
        numbers = self._numbers()
        number = (numbers or [0])[-1] + 1
        found = source.scan_all(self.spark, self.watches).select("path", F.col("modificationTime").alias("modified"), "length")
        listing = self.spark.read.schema(LISTED).parquet(self._write(found, f"listed/{number:08d}-{time.time_ns()}"))
        before = self._listing(numbers[-1]) if numbers else self.spark.createDataFrame([], LISTED)
        events = changes(listing, before).select(F.xxhash64("path", F.lit(number)).alias("event_id"), "path", "kind", F.lit(time.time()).alias("at"))
        told = self._tell(events)
        self._write(listing, f"listings/{number:08d}")
        for old in numbers[:-1]:
            snapshots.remove(self.spark, self.state, [f"listings/{old:08d}"])
        snapshots.remove(self.spark, self.state, ["listed"])
        return told

    def _write(self, df: DataFrame, name: str) -> str:
        df.write.mode("overwrite").parquet(f"{self.state}/{name}")
        return f"{self.state}/{name}"

    def _tell(self, events: DataFrame) -> int:
        name, known = snapshots.part(events, self.state, "told")
        if known["rows"]:
            self.spark.read.schema(EVENTS).parquet(f"{self.state}/{name}").write.mode("append").parquet(f"{self.state}/events")
        snapshots.remove(self.spark, self.state, [name])
        return known["rows"]

    def finished(self, paths: DataFrame) -> None:
        """Say that files are done: they can be submitted again."""
        self._tell(paths.select(F.xxhash64("path", F.lit(time.time_ns())).alias("event_id"), "path", F.lit("done").alias("kind"), F.lit(time.time()).alias("at")))

    def events(self) -> DataFrame:
        """The stream of events: ``created`` and ``modified`` files, and those ``done``."""
        if not snapshots.exists(self.spark, f"{self.state}/events"):
            self.spark.createDataFrame([], EVENTS).write.mode("append").parquet(f"{self.state}/events")
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.state}/events")

    def submissions(self, seconds: float = ingest.THROTTLE_S) -> DataFrame:
        """The stream of files to ingest: throttled, and none that is queued or in work already."""
        accepted = ingest.throttle_stream(self.events().where("kind <> 'done'"), seconds).withColumn("done", F.lit(False))
        done = self.events().where("kind = 'done'").select("event_id", "path", "at", F.lit(True).alias("done"))
        return ingest.tracked_stream(accepted.unionByName(done))

    def start(self, every: str = "3 seconds") -> StreamingQuery:
        """Poll again and again, as a query that can be stopped and listened to."""
        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return ticks.writeStream.foreachBatch(lambda batch, number: self.poll() and None).option("checkpointLocation", f"{self.state}/ticks").trigger(processingTime=every).start()
