"""Packing into contexts of several lengths: hierarchical multi-length packing.

Every text is encoded and closed with an end id. Whole contexts of long texts are sequences by themselves; what
is left of a text goes to the shortest tier of context lengths that holds it. Tiers are packed from the longest
to the shortest: a piece opens a sequence of its tier, and the gap behind it is filled from the shorter tiers,
with the longest piece that fits as long as there is one, then with a cut from the longest piece there is. So
sequences are full, and a text is cut only where a gap ends. Sequences of a tier are dealt to steps of equal token
counts so that the steps' attention costs (sums of squared piece lengths) are alike.

A task packs its own rows, a bounded window of tokens at a time: nothing is shuffled, no hot source or copied
text meets in one task, and a lost task is packed again from its rows alone.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import ids_and_texts

#: Context lengths; powers of two.
TIERS = (4096, 2048, 1024, 512, 256)
#: Tokens of a window, and of a step.
WINDOW_TOKENS = 1 << 22
STEP_TOKENS = 1 << 16
END = 2
#: Bytes of text that are encoded together.
TEXT_BYTES = 1 << 24

Piece = tuple[int, int, int]


#: How a tokenizer with word ends takes texts apart, and the strings that its bytes are written as.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
WORD_END = "</w>"
#: The same over characters below U+0180 but the dotted capital I: their classes, lower case and composition are the same everywhere.
SPACE, LETTER, NUMBER = "\t\n\x0b\x0c\r \x85\xa0", "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
PIECE = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
PLAIN = r"^[\x00-\x1b\x20-\x{12f}\x{131}-\x{17f}]*$"


def merges_of(model: str) -> dict[bytes, int] | None:
    """The tokenizer's tokens as bytes, a space for the end of a word, if it is byte-level BPE with word ends over
    ``PATTERN`` whose ids are in the order of its merges; else None."""
    parts = json.loads(model)
    own, normal, before = parts["model"], parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
    kinds = [n["type"] for n in normal.get("normalizers", [])], [(n["type"], n.get("pattern"), n.get("invert")) for n in before.get("pretokenizers", [])]
    if kinds != (["NFC", "Replace", "Lowercase"], [("Split", {"Regex": PATTERN}, True), ("ByteLevel", None, None)]) or own["type"] != "BPE" or own["end_of_word_suffix"] != WORD_END:
        return None
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in own["merges"]]
    if [own["vocab"].get(m) for m in joined] != list(range(512, 512 + len(joined))):
        return None
    rest = [b for b in range(256) if b not in PRINTED]
    byte = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in parts["added_tokens"]}
    return {bytes(byte[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END): i for t, i in own["vocab"].items() if t not in special}


class Encoder:
    """The ids of texts by a tokenizer whose pre-tokens hold no white space.

    Between spaces and line feeds its work does not depend on what stands beyond them, so each distinct stretch of
    a batch is encoded once. Stretches of common characters go through the same merges by rank, their pieces
    closed with a space for the end of the word; all others through the tokenizer itself.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        # Strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        ranks = merges_of(model)
        self.merges = tiktoken.Encoding("word ends", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.line = ranks[b"\n "] if ranks else None

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct words without line feeds, and where each word's begin and end among them."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) if self.merges else np.zeros(len(words), bool)
        sizes, ids = np.zeros(len(words), np.int64), [np.zeros(0, "<u4")]
        if plain.any():
            # Words are lines, and a line feed is a piece and an id of its own.
            some = words.filter(pa.array(plain))
            lines = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), "\n")[0].as_py().lower() + "\n"
            found = np.array(self.merges.encode_ordinary(" ".join(PIECE.findall(lines)) + " "), "<u4")
            ends = np.flatnonzero(found == self.line)
            sizes[plain] = np.diff(ends, prepend=-1) - 1
            ids.append(np.delete(found, ends))
        others = [e.ids for e in self.tokenizer.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        sizes[~plain] = [len(o) for o in others]
        ids.append(np.fromiter(itertools.chain.from_iterable(others), "<u4"))
        # The plain words' ids come first.
        order, starts = np.argsort(~plain, kind="stable"), np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(ids), starts, starts + sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Little-endian 32-bit ids of every text."""
        if not len(texts):
            return []
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        ids, starts, ends = self.words(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes = (ends - starts)[which]
        stops = np.cumsum(sizes)
        flat = ids[np.repeat(starts[which] - (stops - sizes), sizes) + np.arange(stops[-1])]
        return np.split(flat, stops[np.cumsum(pc.list_value_length(words).to_numpy()) - 1][:-1])


class Pool:
    """Pieces by length; a number's bits tell which lengths there are."""

    def __init__(self, most: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
        self.lengths = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.lengths |= 1 << length

    def longest(self, most: int) -> Piece | None:
        """Take a piece of the greatest length up to ``most``."""
        length = (self.lengths & ((2 << most) - 1)).bit_length() - 1
        if length < 0:
            return None
        held = self.by_length[length]
        doc, start = held.pop()
        if not held:
            self.lengths ^= 1 << length
        return doc, start, length


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The shortest tier that holds a piece."""
    return min(t for t in tiers if t >= length)


def powers(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_window(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """``(context, pieces)`` of every sequence; pieces are ``(text, start, length)`` and fill the context.

    Tokens that fill no context of the shortest tier, less than one at the end, become sequences of smaller
    powers of two, so nothing is padded.
    """
    tiers = tuple(sorted(tiers, reverse=True))
    most, out, pool = tiers[0], [], Pool(tiers[0])
    for doc, n in enumerate(lengths):
        whole = n // most
        out += [(most, [(doc, i * most, most)]) for i in range(whole)]
        if n % most:
            pool.add(doc, whole * most, n % most)
    while first := pool.longest(most):
        context = tier_of(first[2], tiers)
        pieces, room = [first], context - first[2]
        while room:
            piece = pool.longest(room)
            if piece is None:
                piece = pool.longest(most)
                if piece is None:
                    break
                doc, start, length = piece
                pool.add(doc, start + room, length - room)
                piece = doc, start, room
            pieces.append(piece)
            room -= piece[2]
        if not room:
            out.append((context, pieces))
            continue
        # The last pieces of a window: sequences of the powers of two that make up their sum.
        for size in powers(context - room):
            cut, left = [], size
            while left:
                doc, start, length = pieces.pop(0)
                if length > left:
                    pieces.insert(0, (doc, start + left, length - left))
                    length = left
                cut.append((doc, start, length))
                left -= length
            out.append((size, cut))
    return out


def deal_steps(costs: list[int], size: int) -> list[int]:
    """The step of every sequence: ``size`` sequences a step at most, the dearest first to the cheapest step with room."""
    steps = -(-len(costs) // size)
    heap = [(0, s, 0) for s in range(steps)]
    out = [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        cost, step, held = heapq.heappop(heap)
        out[i] = step
        if held + 1 < size:
            heapq.heappush(heap, (cost + costs[i], step, held + 1))
    return out


def steps_of(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """The step of every sequence, tier by tier."""
    out, used = [0] * len(sequences), 0
    by_tier: dict[int, list[int]] = {}
    for i, (context, _) in enumerate(sequences):
        by_tier.setdefault(context, []).append(i)
    for context, members in sorted(by_tier.items(), reverse=True):
        dealt = deal_steps([sum(n * n for _, _, n in sequences[i][1]) for i in members], max(1, step_tokens // context))
        for i, step in zip(members, dealt):
            out[i] = used + step
        used += max(dealt) + 1
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many together as have ``TEXT_BYTES`` in their second column, one at least."""
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def read_model(path: str) -> str:
    """A tokenizer's definition, to be sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context long, step long"


def pack(docs: DataFrame, model: str, end: int = END, tiers: tuple[int, ...] = TIERS, window_tokens: int = WINDOW_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a text, in the order of their sequences.

    ``doc_id, start, length``: which of the text's ids; ``ids``: those, as little-endian 32-bit numbers;
    ``doc_tokens``: how many the text has, the end id among them; ``sequence_id, offset``: where the piece stands;
    ``context``: the sequence's length, a tier or, at the end of a window, a smaller power of two, always filled;
    ``step``: sequences of one context that are to be trained on together, ``step_tokens`` at most.

    Null and empty texts are one end id. Rows with a null or repeated doc_id are packed like others, each by
    itself. An empty table gives no rows; other columns are not read. A text longer than a window makes up a
    window with what came before it; a task holds the ids of one window and those of its longest text. Names of
    sequences and steps hold the task's number, so a rerun over the same files packs the same.
    """
    if sorted(tiers) != sorted({1 << t.bit_length() - 1 for t in tiers}):
        raise ValueError("tiers are distinct powers of two")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = Encoder(shared.value), TaskContext.get().partitionId() << 40
        doc_ids, ids, held, sequences_before, steps_before = [], [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequences_before, steps_before
            sequences = pack_window([len(x) for x in ids], tiers)
            steps = steps_of(sequences, step_tokens)
            for at in range(0, len(sequences), 512):
                out = []
                for number, (context, pieces) in enumerate(sequences[at : at + 512], at):
                    offset = 0
                    for doc, start, n in pieces:
                        piece = ids[doc][start : start + n].tobytes()
                        out.append((doc_ids[doc], start, n, piece, len(ids[doc]), base + sequences_before + number, offset, context, base + steps_before + steps[number]))
                        offset += n
                kinds = [pa.binary() if c == 3 else pa.int64() for c in range(9)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            sequences_before, steps_before = sequences_before + len(sequences), steps_before + max(steps) + 1

        for batch in batches:
            for some in slices(batch):
                for doc_id, got in zip(some.column(0).to_pylist(), encoder.encode(some.column(1))):
                    doc_ids.append(doc_id)
                    ids.append(np.append(got, np.array([end], "<u4")))
                    held += len(ids[-1])
                    if held >= window_tokens:
                        yield from flush()
                        doc_ids.clear()
                        ids.clear()
                        held = 0
        if ids:
            yield from flush()

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, context, step, ids, cu_seqlens, doc_ids, starts)``: one row per sequence of ``pack``'s pieces.

    ``cu_seqlens`` are cumulative piece lengths from 0; a sequence has ``context`` pieces at most. No pieces, no rows.
    """
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    rows = packed.groupBy("sequence_id", "context", "step").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("p", lambda x: x["offset"] + x["length"]))
    return rows.select("sequence_id", "context", "step", ids.alias("ids"), ends.alias("cu_seqlens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"))
