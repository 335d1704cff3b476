"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens and each document becomes the sequence of its pre-tokens' numbers in its
block's list of distinct ones, which keeps every position in two bytes or so. The lists are dealt by
word, so that every distinct word of the corpus meets in one place and is encoded once there; the ids
go back to the blocks that asked, and documents are put together again by position. Decoding looks up
the ids of each distinct word in the token-byte table. Shuffle rows are compressed lists instead of
single words and positions: the same movement in a tenth of the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, partitions_for

#: A block's documents are held together in one task: about so many bytes of text.
BLOCK_BYTES = 32 << 20
DOCS, WORDS = 0, 1
#: A partition's next block has a place this much on: a prime, so that homes differ.
PLACES = 1_000_003
DOCS_TOGETHER = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_codecs: dict[tuple[str, int, int], tiktoken.Encoding] = {}
#: A word is encoded as one match.
WHOLE = r"(?s).+"


def codec(pattern: str, ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """One encoder per worker process, pattern and vocabulary."""
    key = (pattern, id(ranks), len(ranks))
    if key not in _codecs:
        _codecs[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _codecs[key]


def as_planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes, lowest first: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(*parts: bytes) -> bytes:
    """Byte strings behind their lengths, compressed."""
    return zstandard.compress(struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts), 6)


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", raw, 4):
        out.append(raw[at : at + size])
        at += size
    return out


def pieces(joined: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def to_varint(x: np.ndarray) -> bytes:
    """Seven bits a byte, lowest first; all but a number's last byte have the top bit."""
    x = x.astype(np.uint32)
    size = 1 + sum((x >= (1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        out[first[has] + k] = ((x[has] >> np.uint32(7 * k)) & np.uint32(127)) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def from_varint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.uint32)
    for k in range(5):
        has = last - first >= k
        out[has] |= (raw[first[has] + k].astype(np.uint32) & np.uint32(127)) << np.uint32(7 * k)
    return out


#: ``key`` is the partition a row goes to next; ``home`` is that of its block.
ROW = "kind byte, key int, home int, block string, slot int, data binary"
_arrow_row = pa.schema([("kind", pa.int8()), ("key", pa.int32()), ("home", pa.int32()), ("block", pa.string()), ("slot", pa.int32()), ("data", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _arrow_row)], schema=_arrow_row)


#: A word's class is the bit length of its count in the block; classes come most frequent first.
CLASSES = 33


def block_rows(place: int, words: dict[str, int], docs: list[tuple[int | None, np.ndarray]], buckets: int) -> Iterator[tuple]:
    """DOCS rows of up to ``DOCS_TOGETHER`` documents, and a WORDS row per bucket of words.

    Words are numbered by class, bucket and spelling: frequent words get short numbers, and the
    numbers follow from the lists and their class sizes alone. Blocks are dealt to partitions by their
    place in the scan. A block's name has a digest of its words and documents: should a rerun find its
    rows in another order, lists of the one never meet documents of the other.
    """
    raw = [w.encode() for w in words]
    counts = np.bincount(np.concatenate([seq for _, seq in docs]), minlength=len(raw)) if raw else np.empty(0, np.int64)
    cls = CLASSES - 1 - np.minimum(np.frexp(counts.astype(np.float64))[1], CLASSES - 1)
    bucket = [xxhash.xxh64_intdigest(w) % buckets for w in raw]
    order = sorted(range(len(raw)), key=lambda i: (bucket[i], cls[i], raw[i]))
    lists: list[list[int]] = [[] for _ in range(buckets)]
    for i in order:
        lists[bucket[i]].append(i)
    number = np.empty(len(raw), np.uint32)
    number[sorted(range(len(raw)), key=lambda i: (cls[i], bucket[i], raw[i]))] = np.arange(len(raw), dtype=np.uint32)
    digest = xxhash.xxh64(repr([d for d, _ in docs]).encode())
    for w in raw:
        digest.update(struct.pack("<I", len(w)) + w)
    for _, seq in docs:
        digest.update(struct.pack("<Q", len(seq)) + seq.tobytes())
    block, home = f"{place}-{digest.hexdigest()}", place % buckets
    for at in range(0, len(docs), DOCS_TOGETHER):
        some = docs[at : at + DOCS_TOGETHER]
        ids = np.array([d or 0 for d, _ in some], "<i8").tobytes()
        known = np.array([d is not None for d, _ in some], np.uint8).tobytes()
        sizes = np.array([len(q) for _, q in some], "<u4").tobytes()
        yield DOCS, home, home, block, -1, pack(ids, known, sizes, to_varint(number[np.concatenate([q for _, q in some])]))
    for b, items in enumerate(lists):
        if items:
            sizes = np.bincount(cls[items], minlength=CLASSES).astype("<u4").tobytes()
            lengths = to_varint(np.array([len(raw[i]) for i in items]))
            yield WORDS, b, home, block, b, pack(sizes, lengths, b"".join([raw[i] for i in items]))


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents to block rows. A block's place is its number within its partition of the scan, dealt so that
    first blocks of partitions go to different homes."""
    split = regex.compile(pattern)
    place, size, words, docs = TaskContext.get().partitionId(), 0, {}, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = split.findall(text)
            docs.append((doc_id, np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found))))
            size += len(text)
            if size >= block_bytes:
                yield _batch(list(block_rows(place, words, docs, buckets)))
                place, size, words, docs = place + PLACES, 0, {}, []
    if docs:
        yield _batch(list(block_rows(place, words, docs, buckets)))


def _encode_lists(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    """WORDS rows become lists of ids; each distinct word of a bucket is encoded once."""
    encode = codec(WHOLE, ranks.value).encode_ordinary
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        out = []
        for kind, key, home, block, slot, data in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == WORDS:
                sizes, lengths, joined = unpack(data)
                ids: list[list[int]] = []
                for w in pieces(joined, from_varint(lengths)):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w.decode())
                    ids.append(got)
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                key, data = home, pack(sizes, to_varint(np.array(list(map(len, ids)))), as_planes(flat))
            out.append((kind, key, home, block, slot, data))
        if out:
            yield _batch(out)


def ordered_words(lists: list[bytes]) -> list[np.ndarray]:
    """Ids of the block's words by number, from the answers of its buckets in order."""
    by_class: list[list[np.ndarray]] = [[] for _ in range(CLASSES)]
    for data in lists:
        sizes, lengths, ids = unpack(data)
        each = np.split(from_planes(ids), np.cumsum(from_varint(lengths))[:-1])
        at = 0
        for c, n in enumerate(np.frombuffer(sizes, "<u4").tolist()):
            by_class[c] += each[at : at + n]
            at += n
    return [x for c in by_class for x in c]


def _assemble(batches: Iterator[pa.RecordBatch], ranks, emit) -> Iterator[pa.RecordBatch]:
    """Rows of a block, lists first, to what ``emit`` makes of each document."""
    table = {i: t for t, i in ranks.value.items()}
    block, lists, words = None, [], None
    for batch in batches:
        for kind, _, _, name, _, data in zip(*(c.to_pylist() for c in batch.columns)):
            if name != block:
                block, lists, words = name, [], None
            if kind == WORDS:
                lists.append(data)
                continue
            if words is None:
                if not lists and any(np.frombuffer(unpack(data)[2], "<u4")):
                    raise RuntimeError("a rerun read the documents in another order: write the input to a table first")
                words, lists = emit.prepare(ordered_words(lists), table), []
            ids, known, sizes, numbers = unpack(data)
            cuts = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)[:-1]
            out = [
                (doc_id if there else None, *emit.document(words, seq))
                for doc_id, there, seq in zip(np.frombuffer(ids, "<i8").tolist(), known, np.split(from_varint(numbers), cuts))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), emit.types)], names=list(emit.names))


class Digests:
    """Token count, digest of the ids as text and digest of the decoded bytes."""

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())

    @staticmethod
    def prepare(words: list[np.ndarray], table: dict[int, bytes]):
        ids = [x.tolist() for x in words]
        as_text = [",".join(map(str, x)).encode() for x in ids]
        raw = [b"".join(map(table.__getitem__, x)) for x in ids]
        return as_text, raw, np.fromiter(map(len, ids), np.int64, len(ids))

    @staticmethod
    def document(words, seq: np.ndarray) -> tuple[int, str, str]:
        as_text, raw, count = words
        order = seq.tolist()
        ids = hashlib.sha256(b",".join(map(as_text.__getitem__, order))).hexdigest()
        return int(count[seq].sum()), ids, hashlib.sha256(b"".join(map(raw.__getitem__, order))).hexdigest()


class Ids:
    """The ids themselves."""

    schema = "doc_id long, ids array<int>"
    names = ("doc_id", "ids")
    types = (pa.int64(), pa.list_(pa.int32()))

    @staticmethod
    def prepare(words: list[np.ndarray], table: dict[int, bytes]):
        return words

    @staticmethod
    def document(words, seq: np.ndarray) -> tuple[np.ndarray]:
        got = [words[i] for i in seq.tolist()]
        return (np.concatenate(got).astype(np.int32) if got else np.empty(0, np.int32),)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, emit, block_bytes: int) -> DataFrame:
    if len(ranks) > 1 << 21:
        raise ValueError("the vocabulary is broadcast: at most two million tokens")
    spark = docs.sparkSession
    n = partitions_for(docs)
    shared = spark.sparkContext.broadcast(ranks)
    blocks = ids_and_texts(docs).mapInArrow(partial(_blocks, pattern=pattern, buckets=n, block_bytes=block_bytes), ROW)
    answered = blocks.repartitionById(n, "key").mapInArrow(partial(_encode_lists, ranks=shared), ROW)
    ordered = answered.repartitionById(n, "key").sortWithinPartitions("block", F.desc("kind"), "slot")
    return ordered.mapInArrow(partial(_assemble, ranks=shared, emit=emit), emit.schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per row of ``docs``.

    Each match of ``pattern`` is encoded by itself, special tokens are ordinary text. Null texts are
    empty and give no tokens (digests of the empty string); null and repeated doc_ids are rows of
    their own; an empty table gives no rows; other columns are not read. A text longer than a block
    is a block of its own.
    """
    return _encoded(docs, ranks, pattern, Digests, block_bytes)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, ids array<int>)``; rules as in ``round_trip``."""
    return _encoded(docs, ranks, pattern, Ids, block_bytes)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``(doc_id, bytes binary)`` from ``(doc_id, ids)`` by the token-byte table.

    A null list gives null, an empty one no bytes; a list with a null or with an id that the vocabulary does not
    have stands for no text and gives null too. Null and repeated doc_ids are rows of their own; an empty
    table gives no rows. The table is broadcast: it has one row per token of a fixed vocabulary.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in shared.value.items()}
        for batch in batches:
            parts = [None if x is None else [table.get(i) for i in x] for x in batch.column(1).to_pylist()]
            out = [None if x is None or None in x else b"".join(x) for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
