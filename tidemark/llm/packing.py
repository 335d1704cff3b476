"""Token-id output: best-fit-decreasing packing of documents into sequences of fixed length.

Every text is encoded, closed with an end token, and cut into pieces of at most ``context`` ids.
Pieces are dealt to shards by hash (long texts to several), and each shard is packed by itself: the
longest piece first, into the open sequence with the least room that still holds it. That sequence is
found in a segment tree over the possible amounts of room.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec
from tidemark.llm.common import ids_and_texts, partitions_for

CONTEXT = 2048
#: Documents a shard has on average, and pieces of one text that stay together.
SHARD_ROWS = 512
PIECES_TOGETHER = 64


class RoomTree:
    """Segment tree over rooms 0..capacity; a leaf counts the open sequences with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, room: int) -> int:
        """Smallest room of an open sequence that is at least ``room``, or -1."""
        i = room + self.size
        if not self.count[i]:
            # Up to the first right-hand neighbour with a sequence in it, then down its left edge.
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The sequence of every piece; ``lengths`` come in descending order."""
    tree, open_, where, n = RoomTree(capacity), [[] for _ in range(capacity + 1)], [], 0
    for length in lengths:
        room = tree.least(length)
        if room < 0:
            seq, room, n = n, capacity, n + 1
        else:
            seq = open_[room].pop()
            tree.add(room, -1)
        if room > length:
            open_[room - length].append(seq)
            tree.add(room - length, 1)
        where.append(seq)
    return where


def end_token(ranks: dict[bytes, int]) -> int:
    """The id that closes a text and fills a row: the first above all ranks, which may have gaps."""
    return max(ranks.values(), default=-1) + 1


def pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str, context: int) -> DataFrame:
    """``(doc_id, piece, n, ids)``: ids as little-endian 32-bit numbers, ``context`` of them at most."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    end = end_token(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(pattern, shared.value).encode_ordinary
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text), end], "<u4")
                out += [(doc_id, i, min(context, len(ids) - a), ids[a : a + context].tobytes()) for i, a in enumerate(range(0, len(ids), context))]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "piece", "n", "ids"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, piece long, n int, ids binary")


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, context: int = CONTEXT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per packed sequence.

    ``shard, seq``: its name; ``n_tokens``: ids in use; ``n_segments``; ``ids``: ``context`` ids as
    little-endian 32-bit numbers, padded with the end token; ``positions``: numbers that start again
    at 0 with each segment (and in the padding); ``cu_seqlens``: cumulative segment lengths from 0;
    ``doc_ids`` and ``pieces`` name the segments. Null and empty texts are one end token; rows with a
    null or repeated doc_id are packed like others; an empty table gives no rows; other columns are not
    read. A rerun packs the same.
    """
    parts = partitions_for(docs)
    shards = max(1, math.ceil(docs.count() / shard_rows))
    shard = F.pmod(F.xxhash64("doc_id", F.floor(F.col("piece") / PIECES_TOGETHER)), F.lit(shards))
    dealt = pieces(docs, ranks, pattern, context).withColumn("shard", shard)
    ordered = dealt.repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)).cast("int")).sortWithinPartitions("shard", F.desc("n"), "doc_id", "piece", "ids")
    end = end_token(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            of = table.column("shard")[0].as_py()
            doc_ids, numbers, lengths, ids = (table.column(c).to_pylist() for c in ("doc_id", "piece", "n", "ids"))
            where = best_fit_decreasing(lengths, context)
            members: list[list[int]] = [[] for _ in range(max(where) + 1)]
            for i, seq in enumerate(where):
                members[seq].append(i)
            for at in range(0, len(members), 256):
                out = []
                for seq, got in enumerate(members[at : at + 256], at):
                    cuts = np.cumsum([0, *(lengths[i] for i in got)])
                    row = np.full(context, end, "<u4")
                    row[: cuts[-1]] = np.frombuffer(b"".join(ids[i] for i in got), "<u4")
                    starts = np.zeros(context, np.int64)
                    starts[cuts[cuts < context]] = cuts[cuts < context]
                    places = (np.arange(context) - np.maximum.accumulate(starts)).astype("<u4")
                    out.append((of, seq, int(cuts[-1]), len(got), row.tobytes(), places.tobytes(), cuts.tolist(), [doc_ids[i] for i in got], [numbers[i] for i in got]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = table.column("shard").to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield from flush(table.slice(a, b - a))
            if len(cuts):
                held[:] = table.slice(int(cuts[-1])).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    names = ["shard", "seq", "n_tokens", "n_segments", "ids", "positions", "cu_seqlens", "doc_ids", "pieces"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    schema = "shard long, seq long, n_tokens long, n_segments long, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<long>"
    return ordered.mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, one file per task, each with whole shards in order of ``(shard, seq)``.

    ``ids`` of a file stacked are its id matrix. ``packed`` has to come from ``pack``, whose tasks hold whole
    shards; a table without rows writes no rows. An existing ``path`` is an error, nothing is overwritten.
    """
    packed.sortWithinPartitions("shard", "seq").write.parquet(path)
