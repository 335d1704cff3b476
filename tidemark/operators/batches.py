"""What a task holds at a time of the batches that Spark hands it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a batch that are worked on together (one row at least), and rows.
TOGETHER, ROWS = 1 << 20, 1024


def slices(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few bytes: a batch may hold thousands of long texts, and what is made of a text in
    Python takes many times its room."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(ROWS, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > together:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n
