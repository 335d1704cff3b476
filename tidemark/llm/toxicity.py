"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of its words and of their prefixes; a document is
toxic if any sentence is (noisy-or), and the weights are fitted to document labels alone. Training
uses at most ``SAMPLE`` labelled rows outside the held-out third (a documented bound: the labelled
rows with the smallest hash of doc_id), gathered in one task; scoring streams over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts

#: Most labelled rows a model is fitted on.
SAMPLE = 6000
DIMS = 1 << 18
PREFIXES = (4, 5, 6)
FOLDS, HELD_OUT_FOLD = 3, 1
THRESHOLD = 0.7
START_BIAS = -8.0
EPOCHS = 30
BATCH = 256
RATE = 0.5
DECAY = 1e-5
#: A feature is used if it is in this many rows and in toxic ones unlike chance by so many deviations.
LEAST_ROWS, LEAST_DEVIATIONS = 3, 4.0
MEMO = 1 << 20

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its prefixes."""
    names = [f"w{word}", *(f"p{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode()) % DIMS for x in names]


class WordScores(dict):
    """Word to summed weight, worked out on first use; emptied when it holds ``MEMO`` words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = float(sum(self.weights[i] for i in features(word)))
        return value


def sentence_logits(text: str, scores: WordScores, bias: float) -> list[tuple[int, int, float]]:
    """(start, end, logit) of every sentence that has a word."""
    out = []
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m.group().lower())
        if words:
            out.append((m.start(), m.end(), bias + sum(map(scores.__getitem__, words))))
    return out


def noisy_or(logits: np.ndarray, bias: float) -> float:
    """1 - prod(1 - sigmoid(z)) on the log scale, less what each sentence gives without any known word.

    Sentences at or below the bias give nothing, so that length alone never adds up; 0 without sentences.
    """
    return float(-np.expm1(-np.maximum(0.0, np.logaddexp(0, logits) - np.logaddexp(0, bias)).sum())) if len(logits) else 0.0


def fit(docs: list[tuple[int, list[np.ndarray]]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, feature ids per sentence), by AdaGrad on the noisy-or loss."""
    rows, toxic = np.zeros(DIMS), np.zeros(DIMS)
    for y, sentences in docs:
        if sentences:
            there = np.unique(np.concatenate(sentences))
            rows[there] += 1
            toxic[there] += y
    share = sum(y for y, _ in docs) / max(1, len(docs))
    away = np.abs(toxic - rows * share) / np.sqrt(np.maximum(rows * share * (1 - share), 1e-9))
    known = (rows >= LEAST_ROWS) & (away >= LEAST_DEVIATIONS)
    w, b = np.zeros(DIMS), START_BIAS
    gw, gb = np.full(DIMS, 1e-6), 1e-6
    packed = []
    for y, sentences in docs:
        kept = [s[known[s]] for s in sentences]
        if kept:
            packed.append((y, np.concatenate(kept), np.array([len(s) for s in kept])))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        at = order.permutation(len(packed))
        for i in range(0, len(at), BATCH):
            part = [packed[j] for j in at[i : i + BATCH]]
            y = np.array([p[0] for p in part], float)
            ids = np.concatenate([p[1] for p in part])
            lengths = np.concatenate([p[2] for p in part])
            doc = np.repeat(np.arange(len(part)), [len(p[2]) for p in part])
            sent = np.repeat(np.arange(len(lengths)), lengths)
            z = b + np.bincount(sent, w[ids], len(lengths))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(part)))
            pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
            g = pull[doc] * p / len(part)
            grad = np.bincount(ids, g[sent], DIMS)
            hit = np.unique(ids)
            grad = grad[hit] + DECAY * w[hit]
            gw[hit] += grad**2
            w[hit] -= RATE * grad / np.sqrt(gw[hit])
            gb += g.sum() ** 2
            b -= 0.1 * RATE * g.sum() / np.sqrt(gb)
    return w.astype(np.float32), float(b)


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled rows that are not held out.

    Labels of one document are combined by their maximum; null labels and ids are ignored. Of rows with
    one doc_id the least text (by code point) is the one that is labelled. Without a usable row the model
    scores every text with the starting bias.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
    chosen = (
        usable.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # Of rows that share a doc_id the one with the least text counts, so that a rerun fits the same model.
    rows = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [], []
            for text in batch.column(2).to_pylist():
                sentences = [[f for w in WORD.findall(m.group().lower()) for f in features(w)] for m in SENTENCE.finditer(text)]
                sentences = [s for s in sentences if s]
                ids.append(np.array([f for s in sentences for f in s], np.int32).tobytes())
                sizes.append(np.array([len(s) for s in sentences], np.int32).tobytes())
            arrays = [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "toxic", "ids", "sizes"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        docs = []
        for r in rows:
            cuts = np.cumsum(np.frombuffer(r["sizes"], np.int32))
            docs.append((r["toxic"], np.split(np.frombuffer(r["ids"], np.int32), cuts[:-1]) if len(cuts) else []))
        w, b = fit(docs)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    found = rows.mapInArrow(extract, "doc_id long, toxic int, ids binary, sizes binary").coalesce(1).mapInArrow(learn, "w binary, b double").first()
    if found is None:
        return np.zeros(DIMS, np.float32), START_BIAS
    return np.frombuffer(found["w"], np.float32), found["b"]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_offending, offending)``, one row per row of ``docs``.

    ``offending`` lists start:end (code points) of the sentences that are toxic by themselves. Null
    and empty texts, and texts without a word, score 0. Rows with a null doc_id count as id text ''.
    Rows of one doc_id are scored each by its text. An empty table gives no rows; other columns are not read.
    """
    w, b = train(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        scores = WordScores(weights)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                spans = sentence_logits(text, scores, bias)
                p = noisy_or(np.array([z for *_, z in spans]), bias)
                bad = [f"{a}:{e}" for a, e, z in spans if z > 0]
                out.append((p, int(p >= THRESHOLD), len(bad), ",".join(bad)))
            cols = list(zip(*out)) if out else [[]] * 4
            types = (pa.float64(), pa.int32(), pa.int64(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted", "n_offending", "offending"])

    scored = ids_and_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int, n_offending long, offending string")
    held_out = fold(F.col("doc_id")) == HELD_OUT_FOLD
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_offending", "offending")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were, whatever their names.

    Null and empty texts stay, null and repeated doc_ids are judged each by its text, and an empty table gives no rows.
    """
    w, b = train(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        scores = WordScores(weights)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            fine = [noisy_or(np.array([z for *_, z in sentence_logits(t or "", scores, bias)]), bias) < THRESHOLD for t in texts]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
