"""Ranked lexical search over a bit-sliced impact index.

A document's score is a sum of integer impacts, one for each term of the question that it holds. Documents stand
in blocks, and a block's index has a bitmap over its documents for every bit of a term's impacts; bitmaps keep the
64-bit words that are not empty. A question's terms are added up for all documents of a block at once, by full
adders over whole bitmaps, and its best documents are read off the sums' bitmaps from the most significant one
down. A first pass over the texts makes the blocks and counts what the weights need, a second one scores.
Documents stay in their tasks; a task lets go the best of each question.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import smallest_of, written

TOP = 10
#: Documents of a block at most, and postings that it may have when a document joins it.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 21
#: Terms of the questions that one pass answers, on average; more questions take several passes.
TERMS_TOGETHER = 200_000
#: Words of sums that are held at once.
SUM_WORDS = 1 << 23
#: A term as bytes of the text; only A to Z have a lower case.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_SCHEMA = "docs long, tokens long, doc_ids array<long>, lengths array<long>, terms array<binary>, ends array<int>, slots array<int>, tfs array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").lower())


@dataclass(frozen=True)
class Statistics:
    """``docs`` with a term, their ``tokens``, and in how many of them a term is."""

    docs: int
    tokens: int
    held_by: dict[bytes, int]

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * self.held_by[term] + 1)))

    def damping(self, lengths: list[int]) -> np.ndarray:
        """What a document's length adds to the count of a term."""
        return np.array([8 * (25 + 75 * n * self.docs // self.tokens) for n in lengths], np.int64)


def items_of(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, item, term, times)``: the terms of every distinct question; ``item`` names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, item, t, n) for i, item, text in zip(*(c.to_pylist() for c in batch.columns)) for t, n in Counter(terms_of(text)).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.binary(), pa.int64()))], names=["item_id", "item", "term", "times"])

    rows = questions.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    name = F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("none")), "text"), 256)
    return rows.select("item_id", name.alias("item"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id long, item string, term binary, times long")


def blocks(docs: DataFrame, asked: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: blocks of documents in order of doc_id, each with the counts of its terms (or of the asked ones).

    ``docs`` and ``tokens`` count the documents of the block with a term and their terms; term ``i`` is in the
    documents ``slots[ends[i - 1]:ends[i]]``, ``tfs`` times. Documents without a term are in no block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rows, postings = shared.value, [], 0

        def block() -> pa.RecordBatch:
            # Null ids come last.
            rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
            held: dict[bytes, list[tuple[int, int]]] = {}
            for slot, (_, _, counts) in enumerate(rows):
                for term, tf in counts:
                    held.setdefault(term, []).append((slot, tf))
            lengths = [r[1] for r in rows]
            ends = np.cumsum([len(v) for v in held.values()]).astype(np.int32)
            flat = [x for v in held.values() for x in v]
            columns = [[len(rows)], [sum(lengths)], [[r[0] for r in rows]], [lengths], [list(held)], [ends], [[s for s, _ in flat]], [[n for _, n in flat]]]
            kinds = [pa.int64(), pa.int64(), *(pa.list_(k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = [(t, n) for t, n in Counter(found).items() if wanted is None or t in wanted]
                rows.append((doc_id, len(found), counts))
                postings += len(counts)
                if len(rows) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield block()
                    rows.clear()
                    postings = 0
        if rows:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def statistics(index: DataFrame, asked: set[bytes] | None = None) -> Statistics:
    """What the weights need, for the terms of ``index`` or those asked for; the driver holds one number a term."""
    docs, tokens = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    sizes = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    each = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), sizes.alias("n"))).alias("x")).select("x.term", "x.n")
    rows = each.groupBy("term").agg(F.sum("n").alias("n")).collect()
    return Statistics(docs, tokens, {bytes(r["term"]): r["n"] for r in rows if asked is None or bytes(r["term"]) in asked})


@dataclass(frozen=True)
class Slices:
    """A term's impacts in a block: ``planes[b, i]`` has bit ``b`` of the documents of the bitmaps' word ``words[i]``."""

    words: np.ndarray
    planes: np.ndarray


def slices(slots: np.ndarray, impacts: np.ndarray) -> Slices:
    """``slots`` ascend."""
    words, starts = np.unique(slots >> 6, return_index=True)
    bits = np.uint64(1) << (slots & 63).astype(np.uint64)
    number = np.arange(int(impacts.max()).bit_length())[:, None]
    return Slices(words, np.bitwise_or.reduceat(np.where(impacts >> number & 1, bits, np.uint64(0)), starts, axis=1))


def add(sums: np.ndarray, rows: np.ndarray, term: Slices, shift: int) -> None:
    """Add a term's impacts times 2^shift to the sums ``[bit, question, word]`` of some questions."""
    where, carry = np.ix_(rows, term.words), None
    for b in range(shift, len(sums)):
        plane = term.planes[b - shift] if b - shift < len(term.planes) else None
        if plane is None and (carry is None or not carry.any()):
            return
        held = sums[b][where]
        if plane is None:
            total, carry = held ^ carry, held & carry
        else:
            half = held ^ plane
            total, carry = (half, held & plane) if carry is None else (half ^ carry, held & plane | half & carry)
        sums[b][where] = total


def best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, slot, score) of the ``k`` highest sums above 0 of every question, equal ones by slot.

    ``sure`` are in, ``open_`` tie so far; a slice moves the ones it holds ahead, or drops the others.
    """
    open_ = np.bitwise_or.reduce(sums, axis=0)
    sure = np.zeros_like(open_)
    for plane in sums[::-1]:
        ahead = open_ & plane
        many = (np.bitwise_count(sure).sum(axis=1, dtype=np.int64) + np.bitwise_count(ahead).sum(axis=1, dtype=np.int64) > k)[:, None]
        sure, open_ = np.where(many, sure, sure | ahead), np.where(many, ahead, open_ & ~plane)
    question, slot = [], []
    for q in range(len(sure)):
        in_, tied = members(sure[q]), members(open_[q])
        got = np.sort(np.concatenate([in_, tied[: k - len(in_)]]))
        question.append(np.full(len(got), q))
        slot.append(got)
    q, s = np.concatenate(question), np.concatenate(slot)
    score = np.zeros(len(q), np.int64)
    for b, plane in enumerate(sums):
        score |= (plane[q, s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
    return q, s, score


def members(bitmap: np.ndarray) -> np.ndarray:
    """The numbers of a bitmap's set bits, ascending."""
    at = np.flatnonzero(bitmap)
    word, bit = np.nonzero(bitmap[at, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
    return at[word] * 64 + bit


class Questions:
    """Some questions' terms: in which questions a term is, and how often."""

    def __init__(self, rows: list):
        self.items = sorted({(r["item"], r["item_id"]) for r in rows}, key=lambda i: i[0])
        number = {item: i for i, (item, _) in enumerate(self.items)}
        self.asked: dict[bytes, list[tuple[int, int]]] = {}
        for r in rows:
            self.asked.setdefault(bytes(r["term"]), []).append((number[r["item"]], r["times"]))


def scored(block: dict, questions: Questions, of: Statistics, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, slot, score): the block's best documents of every question."""
    damping, slots, tfs = of.damping(block["lengths"]), np.array(block["slots"], np.int64), np.array(block["tfs"], np.int64)
    terms: list[tuple[Slices, list[tuple[int, int]]]] = []
    most = [0] * len(questions.items)
    for term, a, b in zip(block["terms"], [0, *block["ends"]], block["ends"]):
        at, tf = slots[a:b], tfs[a:b]
        impacts = of.weight(term) * (1_000_000_000 * tf // (1000 * tf + damping[at]))
        if term in questions.asked and impacts.any():
            terms.append((slices(at, impacts), questions.asked[term]))
            for q, times in questions.asked[term]:
                most[q] += times * int(impacts.max())
    words = (len(damping) + 63) // 64
    depth = max(most, default=0).bit_length()
    together = max(1, SUM_WORDS // (words * max(1, depth)))
    for first in range(0, len(most), together):
        here = min(together, len(most) - first)
        sums = np.zeros((depth, here, words), np.uint64)
        for term, asked in terms:
            by_shift: dict[int, list[int]] = {}
            for q, times in asked:
                if first <= q < first + here:
                    for bit in range(times.bit_length()):
                        if times >> bit & 1:
                            by_shift.setdefault(bit, []).append(q - first)
            for shift, rows in by_shift.items():
                add(sums, np.array(rows), term, shift)
        if depth:
            q, s, score = best(sums, k)
            yield q + first, s, score


def search(index: DataFrame, questions: Questions, of: Statistics, k: int = TOP) -> DataFrame:
    """``(item, item_id, doc_id, score)``: every task's ``k`` best documents of every question."""
    shared = index.sparkSession.sparkContext.broadcast((questions, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, of = shared.value
        kept: list[list[tuple[bool, int | None, int]]] = [[] for _ in questions.items]
        for batch in batches:
            for block in batch.to_pylist():
                for q, slot, score in scored(block, questions, of, k):
                    for i, s, n in zip(q.tolist(), slot.tolist(), score.tolist()):
                        kept[i].append((-n, block["doc_ids"][s]))
                for i, rows in enumerate(kept):
                    kept[i] = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1]))[:k]
        out = [(*questions.items[i], doc_id, -n) for i, rows in enumerate(kept) for n, doc_id in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item string, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, questions: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank int, doc_id, score)``: the ``k`` highest-scoring documents above 0 of every question.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A to Z in lower case. A term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), and a document's impact is that times 10^9 tf div (1000 tf + 8 m), with
    m = 25 + 75 n N div L; N documents have a term, L all their terms, df the documents with this one. A term
    that a question repeats counts as often.

    Null and empty texts have no term: such documents are in no block and not counted, such questions get no
    rows. Equal scores are ranked by doc_id, null ids last; rows that repeat a doc_id are documents of their own.
    Questions that share an id but not the text are ranked each by itself, repeated rows once. Empty tables give
    no rows; other columns are not read. Questions are answered in lots of some ``TERMS_TOGETHER`` terms, each by
    a pass over all documents.
    """
    spark = docs.sparkSession
    asked = written(items_of(questions, id_col, text_col))
    lots = max(1, math.ceil(asked.count() / TERMS_TOGETHER))
    out = spark.createDataFrame([], "item string, item_id long, doc_id long, score long")
    for lot in range(lots):
        some = Questions(asked.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == lot).collect())
        index = written(blocks(docs, set(some.asked)))
        out = out.unionByName(search(index, some, statistics(index), k))
    best_ = smallest_of(out, k, ["item", "item_id"], F.desc("score"), F.asc_nulls_last("doc_id"))
    return best_.select("item_id", F.col("_rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
),
held AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM held),
items AS (
  SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
),
asked AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM items) GROUP BY i, item_id, t),
post AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM held)
  WHERE t IN (SELECT t FROM asked) GROUP BY r, doc_id, n, t
),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM post GROUP BY t), total),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // tokens)))) AS BIGINT) AS score
  FROM post JOIN weights USING (t) JOIN asked USING (t), total GROUP BY i, item_id, r, doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
""".strip()
