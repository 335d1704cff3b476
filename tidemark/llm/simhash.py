"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints are computed once per text, equal ones collapse into a class before anything else is
shuffled, and classes meet in buckets: the 64 bits are cut into 8 blocks of 8, and two fingerprints
that differ in at most ``radius`` (2) bits agree in at least 6 blocks, so they share one of the 28
tables keyed by six blocks. A bucket fixes 48 bits and so never holds more than 65,536 distinct
fingerprints, whatever the input. Bit planes are stored vertically, 64 distances are counted at once
with carry-save counters, and a word is abandoned when every distance in it exceeds the radius. Small
buckets lie side by side in common words, which are compared with themselves, shifted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ids_and_texts, shuffle_partitions
from tidemark.llm.components import connected_components, spanning

BLOCKS = 8
RADIUS = 2
#: Links of a bucket that are held before they are brought down to a spanning forest.
FOREST = 1 << 21
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """SimHash of a text's 3-word shingles; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - 2)
    spans = zip(starts[:n].tolist(), ends[min(2, len(words) - 1) :].tolist())
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in spans])
    total = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp long)``: the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, fp long")


def bit_planes(x: np.ndarray) -> np.ndarray:
    """64 rows of words; bit j of plane b is bit b of ``x[j]`` (rows padded to whole words)."""
    n = len(x)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    words = -(-n // 64)
    out = np.zeros((64, words * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def counted(diff: Callable[[int, tuple[np.ndarray, ...]], np.ndarray], cells: tuple[np.ndarray, ...], over: np.ndarray, radius: int = RADIUS) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The cells with a lane within the radius, and those lanes as set bits.

    A cell is one word of 64 comparisons; ``diff(plane, cells)`` says where a plane differs. ``ones`` and
    ``twos`` are the low bits of 64 counters a word, ``over`` collects the lanes beyond the radius (or
    not to be compared at all). Every eight planes, cells in which every lane is over are abandoned.
    """
    if radius != 2:
        raise ValueError("the counters are built for a radius of 2")
    ones = np.zeros(len(over), np.uint64)
    twos = ones.copy()
    for b in range(64):
        d = diff(b, cells)
        carry = ones & d
        ones ^= d
        over = over | (twos & carry) | (twos & ones)
        twos |= carry
        if b % 8 == 7:
            alive = over != ALL
            if not alive.all():
                cells = tuple(c[alive] for c in cells)
                ones, twos, over = ones[alive], twos[alive], over[alive]
                if not len(over):
                    break
    return cells, ~over


def within_radius(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bit-sliced Hamming filter: row q holds the words whose set bits mark fingerprints near query q."""
    m, w = len(queries), planes.shape[1]
    out = np.zeros((m, w), np.uint64)

    def diff(b: int, cells: tuple[np.ndarray, ...]) -> np.ndarray:
        flip = np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1))
        return planes[b][cells[1]] ^ flip[cells[0]]

    cells = tuple(a.ravel() for a in np.mgrid[0:m, 0:w])
    (qi, wi), near = counted(diff, cells, np.zeros(m * w, np.uint64), radius)
    out[qi, wi] = near
    return out


def set_lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little").astype(bool)


def packed_links(x: np.ndarray, size: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i > j) within the radius of many buckets that lie one after another in the same words.

    ``size`` holds the buckets' sizes, largest first. All lanes are compared with the lanes ``shift``
    places on, whole words at a time; lanes whose bucket is no longer than the shift are over from the
    start, and as large buckets come first, each shift concerns a beginning of the words only.
    """
    planes = bit_planes(x)
    planes = np.concatenate([planes, np.zeros((64, 2), np.uint64)], axis=1)
    own = np.repeat(size, size)
    left = own - (np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size))
    i, j = [], []
    for shift in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-own, -shift))  # lanes of buckets with more than ``shift`` members
        words = np.arange(-(-n // 64))
        lanes = np.zeros(64 * len(words), np.uint8)
        lanes[:n] = left[:n] > shift
        over = ~np.packbits(lanes, bitorder="little").view("<u8")
        step, low = divmod(shift, 64)

        def diff(b: int, cells: tuple[np.ndarray, ...]) -> np.ndarray:
            w = cells[0] + step
            moved = planes[b][w] >> np.uint64(low)
            if low:
                moved = moved | planes[b][w + 1] << np.uint64(64 - low)
            return planes[b][cells[0]] ^ moved

        (w,), near = counted(diff, (words,), over, radius)
        row, lane = np.nonzero(set_lanes(near))
        at = w[row] * 64 + lane
        i.append(at + shift)
        j.append(at)
    none = np.empty(0, np.int64)
    return (np.concatenate(i), np.concatenate(j)) if i else (none, none)


def bucket_links(x: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i > j) of one bucket's distinct fingerprints within the radius, as a spanning forest of
    them: that loses no connection, and a bucket's links never fill the memory."""
    n = len(x)
    planes = bit_planes(x)
    i, j, held = [], [], 0
    step = max(1, (1 << 18) // planes.shape[1])
    for at in range(0, n, step):
        near = within_radius(planes, x[at : at + step], radius)
        row, lane = np.nonzero(set_lanes(near.ravel()).reshape(len(near), -1)[:, :n])
        row += at
        keep = row > lane
        i.append(row[keep])
        j.append(lane[keep])
        held += int(keep.sum())
        if held > FOREST:
            a, b = spanning(np.concatenate(i), np.concatenate(j))
            i, j, held = [a], [b], 0
    return spanning(np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, np.int64),) * 2


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)`` between class representatives whose fingerprints differ in at most ``radius`` bits.

    ``classes`` is ``(fp long, rep long)`` with distinct ``fp``. Links within a large bucket come as a
    spanning forest: components of the result equal those of all links.
    """
    width = 64 // BLOCKS
    tables = []
    for t, left_out in enumerate(combinations(range(BLOCKS), radius)):
        mask = (1 << 64) - 1
        for block in left_out:
            mask &= ~(((1 << width) - 1) << (block * width))
        mask -= (mask >> 63) << 64
        tables.append(F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("k")))
    keyed = classes.select("fp", "rep", F.explode(F.array(*tables)).alias("b")).select("b.t", "b.k", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, k, fp, rep = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(4))
        order = np.lexsort((fp, k, t))
        t, k, fp, rep = t[order], k[order], fp[order].view(np.uint64), rep[order]
        starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
        ends = np.concatenate([starts[1:], [len(t)]])
        size = ends - starts
        us, vs = [], []
        # Buckets of up to a word of fingerprints share words, largest first; larger ones have words of their own.
        small = np.flatnonzero((size > 1) & (size <= 64))
        small = small[np.argsort(-size[small], kind="stable")]
        for at in range(0, len(small), 1 << 18):
            some = small[at : at + (1 << 18)]
            row = np.repeat(starts[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
            i, j = packed_links(fp[row], size[some], radius)
            us.append(rep[row[i]])
            vs.append(rep[row[j]])
        for s in np.flatnonzero(size > 64).tolist():
            i, j = bucket_links(fp[starts[s] : ends[s]], radius)
            us.append(rep[starts[s] + i])
            vs.append(rep[starts[s] + j])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    n = shuffle_partitions(classes.sparkSession)
    return keyed.repartition(n, "t", "k").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero and link like any other; rows with a null
    doc_id are kept, get their own fingerprint and the component of their class; an empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(links(classes.where("rep is not null"), radius))
    # The class table is joined first: a class's members then need one join on fp only.
    named = classes.join(parts, classes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; all columns as they were.

    Rows with a null doc_id cannot be named by a component and stay.
    """
    kept = near_duplicates(docs, radius).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    # The row travels as a struct: no name of its columns can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    named = rows.where("row.doc_id is not null").join(kept, F.col("row.doc_id") == F.col("kept"), "left_semi")
    return named.unionByName(rows.where("row.doc_id is null")).select("row.*")
