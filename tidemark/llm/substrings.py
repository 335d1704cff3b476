"""Removal of repeated 100-byte strings with a hash-compared suffix sort.

Finding them takes two steps, both over all bytes.

1. Anchors. In every 100-byte window the position with the smallest hash of ``GRAM`` bytes is its
   anchor, so equal windows have equal anchors at equal offsets. Windows that follow one another
   mostly share their anchor: such a run, with the text it covers (its context), is one row. Runs of
   equal context are copies of each other; all but the first are removed whole. What is left is one
   run per distinct context, and only anchors with several distinct contexts need a closer look.
2. Suffix sort. The contexts of an anchor meet in one task, at most ``GROUP`` at a time. The suffixes
   that start their windows are merge-sorted; two suffixes are compared by the length of their common
   extension, found by binary search over prefix polynomial hashes (seven probes for 100 bytes).
   Neighbours in the result are compared byte by byte over what they have in common, which proves the
   order and the equalities. Groups of more than ``GROUP`` contexts are sorted part by part, and the first
   window of each class and part meets those of the other parts by its hash.

No byte goes by a hash alone: copies in a block of texts are compared where they are, others get the
bytes of the run they are copies of, and are compared with their own text. Should a hash have deceived
anywhere, nothing is removed and all is done again with other bases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, partitions_for, written

#: Bytes of a repeated string; bytes hashed for an anchor; contexts sorted together.
LENGTH, GRAM, GROUP = 100, 40, 512
#: Texts are held together for in-task de-duplication up to so many bytes.
BLOCK_BYTES = 24 << 20
#: Suffixes sorted at once.
CHUNK = 1 << 19

#: Odd bases of the two polynomial hashes (arithmetic is modulo 2**64) by attempt, and mixers.
BASES = (
    (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F),
    (0xBF58476D1CE4E5B9, 0x94D049BB133111EB),
    (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D),
    (0x369DEA0F31A53F85, 0xD1342543DE82EF95),
)
#: Copies of one run that get its bytes from one row.
COPIES_TOGETHER = 64
MIX = (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, or those of its inverse."""
    got = _powers.get((base, inverse))
    if got is None or len(got) <= n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(17, int(n).bit_length())
        got = np.full(size + 1, step, np.uint64)
        got[0] = 1
        _powers[base, inverse] = got = np.cumprod(got, dtype=np.uint64)
    return got


def prefix_hashes(data: np.ndarray, base: int) -> np.ndarray:
    """h[i] is the sum of data[j] * base**j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data))[: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    return np.minimum(v[: len(v) - (width - w)], v[width - w :]) if w < width else v


def anchor_runs(data: np.ndarray, bases: tuple[int, int] = BASES[0]) -> tuple[np.ndarray, ...]:
    """(first window, last window, offset of the anchor, anchor hash, context hash) of every run.

    Positions are worked out in pieces of 2**20 windows so that they fit the low bits of a hash; runs
    are cut at a piece's end, which splits a run but loses no window.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    low = np.uint64((1 << 20) - 1)
    h, h2 = prefix_hashes(data, bases[0]), prefix_hashes(data, bases[1])
    grams = mixed((h[GRAM:] - h[:-GRAM]) * powers(bases[0], n, True)[: n - GRAM + 1], MIX[0])
    starts, ends, anchors = [], [], []
    for at in range(0, n - LENGTH + 1, (1 << 20) - LENGTH):
        part = grams[at : at + (1 << 20)][: n - GRAM + 1 - at]
        windows = min((1 << 20) - LENGTH, n - LENGTH + 1 - at)
        part = part[: windows + LENGTH - GRAM]
        v = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        p = (sliding_min(v, LENGTH - GRAM + 1) & low).astype(np.int64)
        s = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        starts.append(s + at)
        ends.append(np.append(s[1:] - 1, len(p) - 1) + at)
        anchors.append(p[s] + at)
    s, e, a = map(np.concatenate, (starts, ends, anchors))
    context = (h2[e + LENGTH] - h2[s]) * powers(bases[1], n, True)[s]
    context = mixed(context + (a - s).astype(np.uint64) * np.uint64(MIX[0]) + (e - s).astype(np.uint64) * np.uint64(BASES[0][0]), MIX[1])
    return s, e, a - s, grams[a], context


RUN = "g long, c long, doc_id long, s int, e int, off int"
_run_names = ["g", "c", "doc_id", "s", "e", "off"]
#: A covered run that is a copy of a run elsewhere names it.
TOLD = RUN + ", of_doc long, of_s int"


def _runs_batch(cols: list[np.ndarray], covered: np.ndarray | None, of: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of RUN; covered ones have no g. With ``of`` (document, start, whether there is none), rows of TOLD."""
    arrays = [pa.array(cols[0].view(np.int64), mask=covered), *(pa.array(x.view(np.int64)) for x in cols[1:3]), *(pa.array(x.astype(np.int32)) for x in cols[3:])]
    if of is None:
        return pa.RecordBatch.from_arrays(arrays, names=_run_names)
    arrays += [pa.array(of[0], mask=of[2]), pa.array(of[1].astype(np.int32), mask=of[2])]
    return pa.RecordBatch.from_arrays(arrays, names=[*_run_names, "of_doc", "of_s"])


def _anchors(batches: Iterator[pa.RecordBatch], bases: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """All runs of the texts; of runs with equal contexts in a block, only the first keeps its anchor.

    Equal contexts of a block are compared byte by byte here.
    """
    docs: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        docs.sort(key=lambda d: d[0])
        parts = [(i, *anchor_runs(data, bases)) for i, (_, data) in enumerate(docs)]
        which = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int64)
        if not len(which):
            return
        s, e, off, g, c = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
        ids = np.array([d for d, _ in docs], np.int64)[which]
        order = np.lexsort((np.arange(len(g)), c, g))
        same = np.concatenate([[False], (g[order][1:] == g[order][:-1]) & (c[order][1:] == c[order][:-1])])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        text = np.concatenate([d for _, d in docs])
        base = np.cumsum([0, *(len(d) for _, d in docs)])[:-1]
        again, of = order[same], first[same]
        equal = same_bytes(text, base[which[again]] + s[again], base[which[of]] + s[of], e[again] - s[again] + LENGTH)
        covered = np.zeros(len(g), bool)
        covered[again[equal]] = True
        for at in range(0, len(g), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield _runs_batch([x[part] for x in (g, c, ids, s, e, off)], covered[part])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if doc_id is None:
                continue
            docs.append((doc_id, np.frombuffer(text, np.uint8)))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from flush()
                docs, size = [], 0
    if docs:
        yield from flush()


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether text[a:a+length] equals text[b:b+length], for every row."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        n = length[at : at + (1 << 14)]
        rows = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        differs = text[a[at : at + (1 << 14)][rows] + step] != text[b[at : at + (1 << 14)][rows] + step]
        out[at + rows[differs]] = False
    return out


def _first_contexts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (g, c, doc_id, s) to covered runs (no g) and to the contexts to compare.

    Of each (g, c) the first run stays a context, the others are covered and name it; their ``c`` numbers
    them in lots of ``COPIES_TOGETHER``. Contexts of an anchor that has but one are dropped; their ``c`` becomes
    the number of the context's part in its anchor's group. The rows stream: only the last anchor's state is
    carried over.
    """
    last_g = last_c = None
    of_doc, of_s, copies = 0, 0, 0  # the last context and its copies so far
    number, held = 0, None  # contexts of the last anchor so far; its only one, not yet passed on
    for batch in batches:
        null = np.asarray(batch.column(0).is_null())
        g, c, d, s, e, off = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(6))
        n = len(g)
        if not n:
            continue
        same_g = np.empty(n, bool)
        same_c = np.empty(n, bool)
        same_g[1:] = (g[1:] == g[:-1]) & ~null[1:] & ~null[:-1]
        same_c[1:] = same_g[1:] & (c[1:] == c[:-1])
        same_g[0] = last_g is not None and not null[0] and g[0] == last_g
        same_c[0] = same_g[0] and c[0] == last_c
        context = ~null & ~same_c
        # The context that a row is a copy of: the last one before it, in this batch or an earlier one.
        first = np.maximum.accumulate(np.where(context, np.arange(n), -1))
        here = first >= 0
        doc_of, s_of = np.where(here, d[first], of_doc), np.where(here, s[first], of_s)
        nth = np.arange(n) - first + np.where(here, 0, copies)
        start = np.flatnonzero(~same_g)
        group = np.cumsum(~same_g)
        upto = np.cumsum(context)
        before = np.concatenate([[0], upto])
        at_start = np.zeros(group[-1] + 1, np.int64)
        at_start[group[start]] = before[start]
        at_start[0] = -number
        ordinal = upto - 1 - at_start[group]
        total = np.bincount(group[context], minlength=group[-1] + 1)
        total[0] += number
        several = total[group] > 1
        if held is not None and group[0] == 0 and total[0] > 1:
            yield held
            held = None
        elif held is not None and group[-1] > 0:
            held = None
        is_last = group == group[-1]
        alone = context & ~several & is_last & (not null[-1])
        if alone.any():
            i = np.flatnonzero(alone)[0]
            held = _runs_batch([x[i : i + 1] for x in (g, np.zeros_like(c), d, s, e, off)], None, (d[i : i + 1], s[i : i + 1], np.ones(1, bool)))
        go = null | (~null & same_c) | (context & several)
        covered = (null | same_c)[go]
        cols = [g[go], np.where(same_c, nth // COPIES_TOGETHER, ordinal // limit)[go], d[go], s[go], e[go], off[go]]
        if go.any():
            yield _runs_batch(cols, covered, (doc_of[go], s_of[go], ~same_c[go]))
        if null[-1]:
            last_g = last_c = None
            number, held = 0, None
        else:
            number = int(total[group[-1]])
            last_g, last_c = g[-1], c[-1]
            of_doc, of_s, copies = int(doc_of[-1]), int(s_of[-1]), int(nth[-1]) + 1


class Collision(Exception):
    """Different bytes had equal hashes."""


def suffix_classes(text: np.ndarray, at: np.ndarray, key: np.ndarray, base: int = BASES[0][0]) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes ``text[at:]`` within equal ``key`` by their first LENGTH bytes.

    Returns the order and, for every place in it, whether it is equal to the place before it; ``Collision``
    if the bytes don't bear the order out.
    A bottom-up mergesort over all keys at once: runs double, an element's place in the merged run is
    its place in its own plus its rank in the other, found by binary search with hashed comparisons.
    """
    h = prefix_hashes(text, base)
    inverse = powers(base, len(text), True)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, at most LENGTH."""
        lo = np.zeros(len(a), np.int64)
        for step in (64, 32, 16, 8, 4, 2, 1):
            hi = lo + step
            fits = hi <= LENGTH
            hi = np.where(fits, hi, lo)
            same = (h[a + hi] - h[a]) * inverse[a] == (h[b + hi] - h[b]) * inverse[b]
            lo = np.where(fits & same, hi, lo)
        return lo

    def precedes(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Suffix a before suffix b; equal ones as ``ties`` says."""
        k = common(a, b)
        whole = k >= LENGTH
        k = np.minimum(k, LENGTH - 1)
        return np.where(whole, ties, text[a + k] < text[b + k])

    order = np.lexsort((at, key))
    keys = key[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    begin, length = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(keys)) - begin
    width = 1
    while len(size) and width < size.max():
        idx = np.flatnonzero(length > width)
        mine = place[idx] // width
        other = mine ^ 1
        lo = begin[idx] + np.minimum(other * width, length[idx])
        end = begin[idx] + np.minimum((other + 1) * width, length[idx])
        first, right = lo.copy(), (mine & 1).astype(bool)
        hi = end.copy()
        suffix = at[order[idx]]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            # A right-hand element comes after equal ones on the left, a left-hand one before its equals.
            below = precedes(at[order[mid]], suffix[open_], right[open_])
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        pair = begin[idx] + (mine >> 1) * (2 * width)
        target = pair + (place[idx] - mine * width) + (lo - first)
        merged = order.copy()
        merged[target] = order[idx]
        order = merged
        width *= 2
    a, b = at[order[1:]], at[order[:-1]]
    equal = np.zeros(len(order), bool)
    near = np.flatnonzero(keys[1:] == keys[:-1])
    a, b = a[near], b[near]
    k = common(a, b)
    whole = k >= LENGTH
    last = np.minimum(k, LENGTH - 1)
    if not same_bytes(text, a, b, k).all() or not (whole | (text[b + last] < text[a + last])).all():
        raise Collision
    equal[near[whole] + 1] = True
    return order, equal


def _compare(batches: Iterator[pa.RecordBatch], limit: int, bases: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (g, part) to covered windows and, for large groups, first windows by hash.

    Rows out: doc_id, s, e (first and last covered window) with null hashes, or one window (s = e)
    with its two hashes. A row without doc_id tells of a collision.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, part, doc, s, e, off = (table.column(i).to_numpy() for i in range(6))
        bodies = table.column(6).to_pylist()
        text = np.frombuffer(b"".join(bodies), np.uint8)
        base = np.cumsum([0, *map(len, bodies)])[:-1]
        change = np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])])
        group = np.cumsum(change) - 1
        many = np.bincount(group)[group] >= limit
        many |= part > 0
        n = e - s + 1
        row = np.repeat(np.arange(len(g)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = base[row] + j
        key = group[row] * (LENGTH + 1) + (off[row] - j)
        try:
            order, equal = suffix_classes(text, at, key, bases[0])
        except Collision:
            yield _windows(np.zeros(1, np.int64), np.zeros(1), np.zeros(1), known=False)
            return
        # The first of each class by (doc_id, start) stays.
        cls = np.cumsum(~equal) - 1
        r = row[order]
        start = s[r] + j[order]
        best = np.lexsort((start, doc[r], cls))
        lead = best[np.concatenate([[True], cls[best][1:] != cls[best][:-1]])]
        stays = np.zeros(len(order), bool)
        stays[lead] = True
        gone = np.flatnonzero(~stays)
        gone = gone[np.lexsort((start[gone], r[gone]))]
        if len(gone):
            jump = np.concatenate([[True], (r[gone][1:] != r[gone][:-1]) | (start[gone][1:] != start[gone][:-1] + 1)])
            a = np.flatnonzero(jump)
            b = np.append(a[1:] - 1, len(gone) - 1)
            yield _windows(doc[r[gone[a]]], start[gone[a]], start[gone[b]])
        hot = np.flatnonzero(stays & many[r])
        if len(hot):
            hashes = []
            for base, by in zip(bases, MIX):
                h = prefix_hashes(text, base)
                p = at[order[hot]]
                hashes.append(mixed((h[p + LENGTH] - h[p]) * powers(base, len(text), True)[p], by))
            yield _windows(doc[r[hot]], start[hot], start[hot], *hashes)

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        g, part = table.column(0).to_numpy(), table.column(1).to_numpy()
        keep = len(g) if final else int(np.flatnonzero((g == g[-1]) & (part == part[-1]))[0])
        rest = table.slice(keep)
        held.clear()
        held.extend(rest.combine_chunks().to_batches())
        table = table.slice(0, keep)
        g, part, n = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(4).to_numpy() - table.column(3).to_numpy() + 1
        if not len(g):
            return
        change = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])]))
        sums = np.cumsum(n)
        at = 0
        for stop in [*change[1:].tolist(), len(g)]:
            if stop == len(g) or sums[stop - 1] - (sums[at - 1] if at else 0) >= CHUNK:
                yield from work(table.slice(at, stop - at))
                at = stop

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= 16384:
                yield from flush(False)
                size = sum(b.num_rows for b in held)
    if held:
        yield from flush(True)


def _windows(doc, s, e, h1=None, h2=None, known: bool = True) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    arrays = [pa.array(doc.astype(np.int64)) if known else none, pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))]
    arrays += [none, none] if h1 is None else [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "s", "e", "h1", "h2"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the runs to compare (packed) to one row per run with its bytes."""
    names = ["g", "part", "doc_id", "s", "e", "off", "body"]
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
        ends, (g, part, s, e, off) = list_fields(batch.column(2))
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        fits = e + LENGTH <= np.array([len(t) for t in texts])[doc]
        g, part, s, e, off, doc = (x[fits] for x in (g, part, s, e, off, doc))
        bodies = [texts[i][a:b] for i, a, b in zip(doc.tolist(), s.tolist(), (e + LENGTH).tolist())]
        arrays = [*map(pa.array, (g, part, ids[doc], s, e, off)), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _cut_originals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a lot of runs that are copies of parts of them, to the bytes that each copy must have.

    Copies that follow one another in both texts are one row.
    """
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        ends, (doc, s, e, of_s) = list_fields(batch.column(1))
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((s, s - of_s, doc, text))
        text, doc, s, e, of_s = (x[order] for x in (text, doc, s.astype(np.int64), e.astype(np.int64), of_s.astype(np.int64)))
        if not len(doc):
            continue
        shift = s - of_s
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1]) | (s[1:] > e[:-1] + 1)])
        start = np.flatnonzero(new)
        stop = np.maximum.reduceat(e, start)
        for at in range(0, len(start), 1 << 12):
            i, last = start[at : at + (1 << 12)], stop[at : at + (1 << 12)]
            bodies = [texts[t][a : a + n] for t, a, n in zip(text[i].tolist(), of_s[i].tolist(), (last - s[i] + LENGTH).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(s[i].astype(np.int32)), pa.array(bodies, pa.binary())], names=["doc_id", "s", "body"])


def _count_unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the bytes that they should have at given places: how many places have others."""
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        wrong = sum(text[c["s"] : c["s"] + len(c["body"])] != c["body"] for text, copies in zip(texts, batch.column(1).to_pylist()) for c in copies)
        yield pa.RecordBatch.from_arrays([pa.array([wrong], pa.int64())], names=["wrong"])


def unlike(texts: DataFrame, copies: DataFrame) -> int:
    """Number of ``copies(doc_id, s, e, of_doc, of_s, lot)`` that don't have the bytes of their originals."""
    lots = copies.groupBy("of_doc", "lot").agg(F.collect_list(F.struct("doc_id", "s", "e", "of_s")).alias("copies"))
    originals = texts.join(lots, F.col("doc_id") == F.col("of_doc")).select("text", "copies").mapInArrow(_cut_originals, "doc_id long, s int, body binary")
    wanted = originals.groupBy("doc_id").agg(F.collect_list(F.struct("s", "body")).alias("wanted"))
    found = texts.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_count_unlike, "wrong long")
    return found.agg(F.coalesce(F.sum("wrong"), F.lit(0))).first()[0]


def list_fields(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a column of lists of structs (a null list is an empty one)."""
    structs = column.values
    return column.offsets.to_numpy(), [structs.field(i).to_numpy(zero_copy_only=False) for i in range(structs.type.num_fields)]


def sorted_runs(texts: DataFrame, group: int, bases: tuple[int, int]) -> DataFrame:
    """Covered runs (no g) and the contexts to compare (``c`` is their part), from all texts."""
    n = partitions_for(texts)
    runs = texts.mapInArrow(partial(_anchors, bases=bases), RUN)
    # Covered runs have no g: they are spread by document.
    dealt = runs.repartition(n, F.coalesce("g", "doc_id")).sortWithinPartitions("g", "c", "doc_id", "s")
    return dealt.mapInArrow(partial(_first_contexts, limit=group), TOLD)


def covered_windows(texts: DataFrame, group: int, bases: tuple[int, int]) -> DataFrame | None:
    """``(doc_id, s, e)``: runs of windows to remove; None if the hashes under these bases deceived."""
    runs = written(sorted_runs(texts, group, bases))
    n = partitions_for(texts)
    to_compare = runs.where("g is not null").groupBy("doc_id").agg(F.collect_list(F.struct("g", "c", "s", "e", "off")).alias("runs"))
    contexts = texts.join(to_compare, "doc_id").select("doc_id", "text", "runs").mapInArrow(
        _cut_contexts, "g long, part long, doc_id long, s int, e int, off int, body binary"
    )
    compared = written(
        contexts.repartition(n, "g", "part")
        .sortWithinPartitions("g", "part")
        .mapInArrow(partial(_compare, limit=group, bases=bases), "doc_id long, s int, e int, h1 long, h2 long")
    )
    # Windows of parts of one large group: at most one per part and class, so these windows are small.
    by_hash = Window.partitionBy("h1", "h2").orderBy("doc_id", "s")
    crossed = compared.where("h1 is not null").withColumn("nth", F.row_number().over(by_hash)).withColumn("of", F.first(F.struct("doc_id", "s")).over(by_hash)).where("nth > 1")
    copies = runs.where("of_doc is not null").select("doc_id", "s", "e", "of_doc", "of_s", F.col("c").alias("lot"))
    again = crossed.select("doc_id", "s", "e", F.col("of.doc_id").alias("of_doc"), F.col("of.s").alias("of_s"), F.floor(F.col("nth") / COPIES_TOGETHER).alias("lot"))
    if compared.where("doc_id is null").limit(1).count() or unlike(texts, copies.unionByName(again)):
        return None
    covered = runs.where("g is null").select("doc_id", "s", "e")
    for late in (compared.where("h1 is null"), crossed):
        covered = covered.unionByName(late.select("doc_id", "s", "e"))
    return covered


def in_order(texts: DataFrame) -> DataFrame:
    """``(doc_id, text, name)``: ``name`` is the given doc_id, ``doc_id`` one that no two rows share, in order.

    Only where ids repeat are the rows sorted and written with new numbers.
    """
    named = texts.withColumn("name", F.col("doc_id"))
    if not texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return named
    ordered = named.where("doc_id is not null").orderBy("doc_id", F.md5("text")).withColumn("doc_id", F.monotonically_increasing_id())
    return written(ordered.unionByName(named.where("doc_id is null")))


def remove_repeats(docs: DataFrame, group: int = GROUP, bases: tuple[tuple[int, int], ...] = BASES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` and ``kept`` (the bytes that stay).

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of smaller
    doc_id, or earlier in the same one. Null and empty texts have nothing to lose; texts under 100
    bytes stay whole. Rows that share a doc_id are documents of their own, in the order of their texts'
    hashes; of equal rows all but one lose everything that is long enough. Rows with a null doc_id have no
    place in the order and stay whole. An empty table gives no rows; other columns are not read. A task holds about
    ``BLOCK_BYTES`` of texts, or one text, and some forty times as much for its hashes.
    """
    texts = in_order(ids_and_texts(docs))
    for pair in bases:
        covered = covered_windows(texts.select("doc_id", "text"), group, pair)
        if covered is not None:
            break
    else:
        raise RuntimeError("all bases of the hashes collided")
    spans = covered.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("covered"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ends, (starts, lasts) = list_fields(batch.column(2))
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                edge = np.zeros(len(text) + 1, np.int32)
                if ends[i] < ends[i + 1]:
                    s = starts[ends[i] : ends[i + 1]]
                    e = lasts[ends[i] : ends[i + 1]] + LENGTH
                    fits = e <= len(text)
                    np.add.at(edge, s[fits], 1)
                    np.add.at(edge, e[fits], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.join(spans, "doc_id", "left").select("name", "text", "covered").mapInArrow(finish, schema)
