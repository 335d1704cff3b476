"""Keyword search over chunks: an inverted index, BM25, substring search and their fallback.

Every search takes a table of questions and answers all of them in one plan. Scores are
sum of ln((N-n+0.5)/(n+0.5)) * f*2.2 / (f + 1.2*(0.25 + 0.75*len/avglen)), the logarithm at least 1e-6;
there is no "+1" in it, so a term that half of the chunks hold weighs next to nothing.
"""

from __future__ import annotations

import itertools
import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.expressions import LEAST_WORD, near_counts, parsed
from tidemark.operators import best
from tidemark.operators.batches import slices
from tidemark.operators.best import NONE, Best
from tidemark.sources.shared import written

#: From a text to its terms: how runs of ideographs, which have no spaces, become words.
Segmenter = Callable[[Column], Column]
TOP_K = 20
LEAST_IDF = 1e-6
DIGITS = 6


@dataclass(frozen=True)
class Index:
    """``postings(term, chunk_id, tf)``, ``lengths(chunk_id, len)`` and one row of ``stats(n_chunks, avglen)``; with
    ``held(chunk_id, terms, len)``, terms as in ``counted_terms``, where postings are still to be dealt from it."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    held: DataFrame | None = None

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """``(number, chunk_id, tf)`` of a few ``terms(term, number)``: others are neither counted nor shuffled."""
        few = F.broadcast(terms)
        if self.held is None:
            return self.postings.join(few, "term").select("number", "chunk_id", "tf")
        found = self.held.select("chunk_id", F.inline("terms")).join(few, "term")
        return found.groupBy("chunk_id", "number").agg(F.sum("tf").alias("tf"))

    def vocabulary(self) -> DataFrame:
        """``term``, each once."""
        every = self.postings.select("term") if self.held is None else self.held.select(F.inline("terms")).select("term")
        return every.distinct()


def index_terms(chunks: DataFrame, segmenter: Segmenter = T.bigrams) -> DataFrame:
    """``(chunk_id, terms)`` of ``chunks(chunk_id, text)`` with text.

    With a column ``is_cjk`` (true for the chunks of files whose first page is in CJK, ``T.is_cjk``), those go
    through the segmenter; other chunks keep runs of ideographs as they stand.
    """
    text = F.col("text")
    found = F.when(F.col("is_cjk"), segmenter(text)).otherwise(T.terms(text)) if "is_cjk" in chunks.columns else T.terms(text)
    return chunks.where(F.coalesce(text, F.lit("")) != "").select("chunk_id", found.alias("terms"))


COUNTED = "array<struct<term: string, tf: long>>"


def counted_terms(chunks: DataFrame, segmenter: Segmenter = T.bigrams) -> DataFrame:
    """``(chunk_id, terms, len)`` of ``chunks`` as for ``index_terms``: a row's distinct terms with how often they
    occur, and how many they are with repeats.

    Terms are counted in Arrow batches, text by text, so that repeats never become rows. Runs of ideographs come whole
    from the JVM where the segmenter is the default one, and their pairs are counted as numbers.
    """
    pairs = F.coalesce("is_cjk", F.lit(False)) if "is_cjk" in chunks.columns and segmenter is T.bigrams else None
    if pairs is None:
        held = index_terms(chunks, segmenter).withColumn("pairs", F.lit(False))
    else:
        text = F.col("text")
        held = chunks.where(F.coalesce(text, F.lit("")) != "").select("chunk_id", T.terms(text).alias("terms"), pairs.alias("pairs"))
    kind = held.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms, sizes = count_terms(batch.column(1), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, pa.array(sizes)], names=["chunk_id", "terms", "len"])

    return held.mapInArrow(run, f"chunk_id {kind}, terms {COUNTED}, len long")


def count_terms(terms: pa.ListArray, pairs: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """Every text's distinct terms with their counts, and the number of its terms; where ``pairs`` says so, runs of
    ideographs are taken as ``bigrams`` does."""
    sizes = np.asarray(pc.fill_null(terms.value_lengths(), 0))
    row, flat = np.repeat(np.arange(len(sizes)), sizes), terms.flatten()
    keys = np.zeros(0, np.int64)
    if pairs.any():
        of = pairs[row]
        split_row, rest, keys = ideograph_pairs(row[of], flat.filter(pa.array(of)))
        row, flat = np.append(row[~of], split_row), pa.concat_arrays([flat.filter(pa.array(~of)), rest])
    words = flat.dictionary_encode("encode")
    n = max(1, len(words.dictionary))
    word, tf = np.unique(row * n + np.asarray(words.indices), return_counts=True)
    pair, pair_tf = np.unique(keys, return_counts=True)
    said, at = np.unique(pair & ((1 << 42) - 1), return_inverse=True)
    named = pa.concat_arrays([words.dictionary, pa.array([chr(x >> 21) + chr(x & 0x1FFFFF) for x in said.tolist()], pa.string())])
    rows, code, tf = np.append(word // n, pair >> 42), np.append(word % n, len(words.dictionary) + at), np.append(tf, pair_tf)
    order = np.argsort(rows, kind="stable")
    ends = np.searchsorted(rows[order], np.arange(len(sizes) + 1)).astype(np.int32)
    held = pa.StructArray.from_arrays([named.take(pa.array(code[order])), pa.array(tf[order])], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends), held), np.bincount(rows, tf, len(sizes)).astype(np.int64)


def ideograph_pairs(row: np.ndarray, terms: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Terms in runs of ideographs and of other characters: (row, run) of those that stay whole, and the pairs of the
    others, each as ``row << 42 | first << 21 | second``."""
    if not len(terms):
        return row[:0], terms, np.zeros(0, np.int64)
    _, ends, data = terms.buffers()
    ends = np.frombuffer(ends, np.int32)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(terms)), np.asarray(pc.utf8_length(terms)))
    han = (point >= 0x4E00) & (point <= 0x9FFF) | (point >= 0x3400) & (point <= 0x4DBF)
    first = np.append(True, (of[1:] != of[:-1]) | (han[1:] != han[:-1]))
    last = np.append(first[1:], True)
    at = np.flatnonzero(han & ~last)
    keys = row[of[at]] << 42 | point[at] << 21 | point[at + 1]
    # What is in no pair: other characters, and ideographs by themselves.
    whole = ~han | first & last
    starts = np.flatnonzero(first & whole)
    width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
    kept = data[np.repeat(whole, width)]
    sizes = np.add.reduceat(width[whole], np.flatnonzero(first[whole])) if len(starts) else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return row[of[starts]], pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept)), keys


def postings_of(held: DataFrame) -> DataFrame:
    """``(term, chunk_id, tf)`` of ``counted_terms``: rows are dealt by chunk, once, and only the terms of a chunk with
    several rows are added up."""
    rows = held.select("chunk_id", "terms", F.count("*").over(Window.partitionBy("chunk_id")).alias("rows"))
    of = lambda some: rows.where(some).select("chunk_id", F.inline("terms"))
    again = of(F.col("rows") > 1).groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))
    return of(F.col("rows") == 1).select("term", "chunk_id", "tf").unionByName(again)


def lengths_of(held: DataFrame) -> DataFrame:
    """``(chunk_id, len)`` of ``counted_terms`` or ``index_terms``."""
    return held.select("chunk_id", (F.col("len") if "len" in held.columns else F.size("terms")).cast("long").alias("len"))


def index_of(postings: DataFrame, lengths: DataFrame) -> Index:
    """An index whose tables are at hand."""
    return Index(postings, lengths, lengths.agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avglen")))


def build_index(chunks: DataFrame, segmenter: Segmenter = T.bigrams) -> Index:
    """Index of ``chunks(chunk_id, text)``; chunks without text are not in it. Texts are taken apart once, into a
    table in the shared folder."""
    held = written(counted_terms(chunks, segmenter))
    return replace(index_of(postings_of(held), lengths_of(held)), held=held)


def question_terms(questions: DataFrame, segmenter: Segmenter = T.bigrams) -> DataFrame:
    """``(query_id, term, times)``; a term that a question repeats counts as often. Questions are always segmented."""
    exploded = questions.select("query_id", F.explode(segmenter(F.col("question"))).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def idf(n_chunks: Column, n: Column) -> Column:
    return F.greatest(F.log((n_chunks - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))


def saturation(f: Column, length: Column, avglen: Column) -> Column:
    return f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avglen))


def top(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` best of every question by rounded score; ties by chunk_id. ``rank`` counts from 0."""
    order = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long") - 1)


#: Rows of question terms or words that one pass answers (on average); more take several passes.
WORDS_TOGETHER = 50_000


def in_lots(asked: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``asked(query_id, ...)`` in lots of whole questions, ``WORDS_TOGETHER`` rows on average."""
    lots = max(1, math.ceil(asked.count() / WORDS_TOGETHER))
    for lot in range(lots):
        yield asked if lots == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(lots)) == lot)


def bm25_topk(index: Index, questions: DataFrame, k: int = TOP_K, segmenter: Segmenter = T.bigrams) -> DataFrame:
    """The ``k`` best chunks of every question, of those that hold one of its terms.

    What the index has of the asked terms is dealt to tasks by chunk, once; the questions' terms, a bounded lot at
    a time, come to every task, which adds up its chunks for all of them and lets go the ``k`` best. So neither a
    frequent term nor many questions multiply what is shuffled. Ids are longs.
    """
    spark = questions.sparkSession
    out = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    asked = written(question_terms(questions, segmenter))
    n_chunks, avglen = index.stats.select("n_chunks", "avglen").first()
    for lot in in_lots(asked):
        rows = lot.collect()
        if not rows:
            continue
        number = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        terms = spark.createDataFrame(list(number.items()), "term string, number long")
        # As many rows as the lot has terms.
        asked_numbers = [(number[r["term"]], r["query_id"], r["times"]) for r in rows]
        out = out.unionByName(_by_number(index.of_terms(terms), index.lengths, asked_numbers, len(number), n_chunks, avglen, k))
    return top(out, k)


def _by_number(counts: DataFrame, lengths: DataFrame, asked: list[tuple[int, int, int]], numbers: int, n_chunks: int, avglen: float, k: int) -> DataFrame:
    """Every task's ``k`` best of ``counts(chunk_id, number, tf)`` for ``asked``, ``(number, query_id, times)``."""
    size = lengths.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("len").cast("double").alias("len"))
    held = written(counts.withColumn("chunk_id", F.col("chunk_id").cast("long")).join(size, "chunk_id"))
    n = np.zeros(numbers)
    for r in held.groupBy("number").agg(F.countDistinct("chunk_id").alias("n")).collect():
        n[r["number"]] = r["n"]
    weight = np.maximum(np.log((n_chunks - n + 0.5) / (n + 0.5)), LEAST_IDF)
    return _term_scores(held, asked, weight, k, avglen or 0.0)


def _term_scores(held: DataFrame, asked: list[tuple[int, int, int]], weight: np.ndarray, k: int, avglen: float) -> DataFrame:
    """Every task's ``k`` best chunks of ``held(chunk_id, number, tf, len)`` for the questions of ``asked``."""
    queries = np.array(sorted({q for _, q, _ in asked}), np.int64)
    term, query, times = (np.array(x) for x in zip(*sorted(asked)))
    column, ends = np.searchsorted(queries, query), np.searchsorted(term, np.arange(len(weight) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, step, left = Best(k), max(1, best.CELLS // len(queries)), None

        def score(table: pa.Table) -> None:
            chunk, number, tf, length = (table.column(c).to_numpy() for c in ("chunk_id", "number", "tf", "len"))
            chunks, row = np.unique(chunk, return_inverse=True)
            value = weight[number] * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avglen)))
            for a in range(0, len(chunks), step):
                some = np.flatnonzero((row >= a) & (row < a + step))
                of, entry = spread(ends, number[some])
                key = (row[some][of] - a) * len(queries) + column[entry]
                shape = min(step, len(chunks) - a), len(queries)
                s = np.bincount(key, value[some][of] * times[entry], shape[0] * shape[1]).reshape(shape)
                there = np.bincount(key, minlength=shape[0] * shape[1]).reshape(shape) > 0
                kept.add(np.where(there, np.round(s, DIGITS), NONE), chunks[a : a + step], queries)

        for batch in slices(batches):
            table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
            # The last chunk may go on in the next batch.
            chunk = table.column("chunk_id").to_numpy()
            cut = int(np.searchsorted(chunk, chunk[-1]))
            if cut:
                score(table.slice(0, cut))
            left = table.slice(cut)
        if left is not None:
            score(left)
        for q, c, s in kept.rows():
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["query_id", "chunk_id", "score"])

    dealt = held.select("chunk_id", "number", "tf", "len").repartition("chunk_id").sortWithinPartitions("chunk_id")
    return dealt.mapInArrow(run, "query_id long, chunk_id long, score double")


def spread(ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every word's entries ``ends[word]..ends[word + 1]``: (place in ``words``, entry)."""
    times = ends[words + 1] - ends[words]
    of = np.repeat(np.arange(len(words)), times)
    return of, np.repeat(ends[words] - (np.cumsum(times) - times), times) + np.arange(len(of))


def filtered_topk(ranked: DataFrame, files: DataFrame, allowed: Column, k: int = TOP_K) -> DataFrame:
    """A file filter on a search's first 3k hits: fewer than ``k`` may be left, by design.

    ``ranked`` holds those hits; ``files(chunk_id, ...)`` has what ``allowed`` speaks of.
    """
    return top(ranked.drop("rank").join(files, "chunk_id").where(allowed), k)


class Phrases:
    """Phrases as the levels of a tree: a node is a beginning, told by the node before it and its last term."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        self.words = sorted({w for p in phrases for w in p})
        number = {w: i for i, w in enumerate(self.words)}
        #: Of every length: the beginnings' keys in order, and which phrase ends there (-1: none).
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        node = {(): 0}
        for size in range(1, max(map(len, phrases), default=0) + 1):
            key = {p[:size]: node[p[: size - 1]] * len(self.words) + number[p[size - 1]] for p in phrases if len(p) >= size}
            order = sorted(key, key=key.get)
            node = {p: i for i, p in enumerate(order)}
            ends = np.full(len(order), -1)
            for i, p in enumerate(phrases):
                if len(p) == size:
                    ends[node[p]] = i
            self.levels.append((np.array([key[p] for p in order], np.int64), ends))

    def find(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, how often it starts there) of the texts' terms."""
        sizes = np.asarray(terms.value_lengths())
        row = np.repeat(np.arange(len(sizes)), sizes)
        word = np.asarray(pc.fill_null(pc.index_in(terms.flatten(), pa.array(self.words, pa.string())), -1)).astype(np.int64)
        at, node, found = np.flatnonzero(word >= 0), 0, []
        for before, (keys, ends) in enumerate(self.levels):
            inside = at + before < len(word)
            at, node = at[inside], node[inside] if before else 0
            here = at + before
            key = np.where((row[here] == row[at]) & (word[here] >= 0), node * len(self.words) + word[here], -1)
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[node] == key
            at, node = at[there], node[there]
            whole = ends[node] >= 0
            found.append(row[at[whole]] * _MOST + ends[node[whole]])
        key, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return key // _MOST, key % _MOST, times


#: Over the number of phrases that one pass looks for.
_MOST = 1 << 32


def phrase_counts(chunks: DataFrame, phrases: list[tuple[str, ...]]) -> DataFrame:
    """``(chunk_id, number, tf)``: how often a phrase's terms follow one another in a chunk, by the phrase's place.

    Texts stay in their tasks: a pass over them looks for all phrases, and only what it finds is shuffled.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    tree = Phrases(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, number, times = tree.find(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(number), pa.array(times)], names=["chunk_id", "number", "tf"])

    found = chunks.select("chunk_id", T.terms(F.col("text")).alias("terms")).mapInArrow(run, f"chunk_id {kind}, number long, tf long")
    return found.groupBy("chunk_id", "number").agg(F.sum("tf").alias("tf"))


def phrase_topk(chunks: DataFrame, index: Index, phrases: DataFrame, k: int = TOP_K) -> DataFrame:
    """BM25 over phrases instead of terms: ``phrases(query_id, phrase_id, phrase)``, each of them an alternative of
    its question. Phrases without a term match nothing. Ids are longs."""
    out = phrases.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    asked = written(phrases.select("query_id", T.terms(F.col("phrase")).alias("terms")).where(F.size("terms") > 0))
    n_chunks, avglen = index.stats.select("n_chunks", "avglen").first()
    for lot in in_lots(asked):
        times = Counter((tuple(r["terms"]), r["query_id"]) for r in lot.collect())
        if not times:
            continue
        number = {p: i for i, p in enumerate(sorted({p for p, _ in times}))}
        counts = phrase_counts(chunks, list(number))
        out = out.unionByName(_by_number(counts, index.lengths, [(number[p], q, n) for (p, q), n in times.items()], len(number), n_chunks, avglen, k))
    return top(out, k)


def expressions(questions: DataFrame) -> DataFrame:
    """``(query_id, words, tree)`` of the questions that are expressions; words in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [parsed(q) for q in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in read], pa.list_(pa.string())), pa.array([t for _, t in read], pa.string())], names=["query_id", "words", "tree"])

    kind = questions.schema["query_id"].dataType.simpleString()
    read = questions.select("query_id", "question").mapInArrow(run, f"query_id {kind}, words array<string>, tree string")
    return read.where("tree is not null").withColumn("words", F.transform("words", F.lower))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def trigram_postings(chunks: DataFrame) -> DataFrame:
    """``(gram, chunk_id)`` of all chunks of three characters or more: an index to keep."""
    return chunks.where(F.length("text") >= 3).select("chunk_id", F.explode(trigrams(F.col("text"))).alias("gram"))


def candidates(chunks: DataFrame, words: DataFrame, grams: DataFrame) -> DataFrame:
    """The chunks that hold the rarest trigram of a word, by a kept index ``grams(gram, chunk_id)``."""
    asked = words.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    held = grams.join(asked.select("gram").distinct(), "gram", "left_semi")
    sizes = held.groupBy("gram").agg(F.count("*").alias("size"))
    # A word one of whose trigrams is nowhere occurs nowhere.
    rarest = Window.partitionBy("word").orderBy(F.asc_nulls_first("size"), "gram")
    chosen = asked.join(sizes, "gram", "left").withColumn("nth", F.row_number().over(rarest)).where("nth = 1").select("gram").distinct()
    return chunks.join(held.join(chosen, "gram", "left_semi").select("chunk_id").distinct(), "chunk_id", "left_semi")


class Asked:
    """Some questions' trees as arrays.

    Columns are phrases first (one for each place in a tree), then what joins them, from the bottom up; a text is a
    row. ``entities`` are what texts are searched for: a word, or a word at a text's start.
    """

    def __init__(self, rows: list):
        self.words = sorted({w for r in rows for w in r["words"]})
        number = {w: i for i, w in enumerate(self.words)}
        self.firsts: dict[int, int] = {}
        self.leaves: list[int] = []
        self.near: list[tuple[int, list[int]]] = []
        joins: list[tuple[int, str, list[tuple[str, int]]]] = []
        plain: list[tuple[int, int]] = []

        def leaf(entity: int, found_by_itself: bool = True) -> tuple[str, int]:
            self.leaves.append(entity)
            if found_by_itself:
                plain.append((entity, len(self.leaves) - 1))
            return "leaf", len(self.leaves) - 1

        def build(tree: list, words: list[str]) -> tuple[tuple[str, int], int]:
            kind = tree[0]
            if kind == "word":
                return leaf(number[words[tree[1]]]), 0
            if kind == "first":
                word = number[words[tree[1]]]
                return leaf(self.firsts.setdefault(word, len(self.words) + len(self.firsts))), 0
            if kind == "never":
                return leaf(0, False), 0
            if kind == "near":
                below = [leaf(number[words[w]], False) for w in tree[2]]
                self.near.append((tree[1], [i for _, i in below]))
                parts = [(c, 0) for c in below]
            else:
                parts = [build(t, words) for t in tree[1]]
            height = 1 + max(h for _, h in parts)
            joins.append((height, "and" if kind == "near" else kind, [c for c, _ in parts]))
            return ("join", len(joins) - 1), height

        roots = [(r["query_id"], build(json.loads(r["tree"]), r["words"])[0]) for r in rows]
        order = sorted(range(len(joins)), key=lambda j: joins[j][:2])
        place = {("join", j): len(self.leaves) + i for i, j in enumerate(order)} | {("leaf", i): i for i in range(len(self.leaves))}
        self.columns = len(self.leaves) + len(joins)
        self.steps: list[tuple[str, int, np.ndarray, np.ndarray]] = []
        for (_, kind), group in itertools.groupby(order, key=lambda j: joins[j][:2]):
            below = [[place[c] for c in joins[j][2]] for j in group]
            ends = np.cumsum([0, *(len(b) for b in below)])
            start = self.steps[-1][1] + len(self.steps[-1][3]) if self.steps else len(self.leaves)
            self.steps.append((kind, start, np.array([c for b in below for c in b]), ends[:-1]))
        self.queries = np.array([q for q, _ in roots], np.int64)
        self.roots = np.array([place[c] for _, c in roots])
        self.of_leaf = np.array(self.leaves, np.int64)
        self.entities = len(self.words) + len(self.firsts)
        entity, self.entry = (np.array(x, np.int64) for x in zip(*sorted(plain))) if plain else (np.zeros(0, np.int64),) * 2
        self.ends = np.searchsorted(entity, np.arange(self.entities + 1))
        #: The phrases of a NEAR by the longest of their words: a text without that one need not be looked at.
        self.near_of: dict[int, list[tuple[int, list[int]]]] = {}
        for within, below in self.near:
            longest = max((self.leaves[c] for c in below), key=lambda w: len(self.words[w]))
            self.near_of.setdefault(longest, []).append((within, below))

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, w in enumerate(self.words):
            out.add_word(w, i)
        if self.words:
            out.make_automaton()
        return out

    def find(self, texts: list[str], automaton: ahocorasick.Automaton) -> tuple[list, list]:
        """Of every text: (entity, how often it occurs there, overlaps included), and (phrase, how often) of the
        phrases of a NEAR."""
        words, nears = [], []
        for text in texts if self.words else [""] * len(texts):
            found = list(automaton.iter(text)) if self.words else []
            seen, near = Counter(w for _, w in found), []
            asked = [(within, below) for w in seen.keys() & self.near_of.keys() for within, below in self.near_of[w] if all(self.leaves[c] in seen for c in below)]
            if asked:
                starts: dict[int, list[int]] = {self.leaves[c]: [] for _, below in asked for c in below}
                for end, w in found:
                    if w in starts:
                        starts[w].append(end - len(self.words[w]) + 1)
                for within, below in asked:
                    of = [self.leaves[c] for c in below]
                    counts = near_counts([starts[w] for w in of], [len(self.words[w]) - 2 for w in of], within)
                    near += [(c, n) for c, n in zip(below, counts) if n]
            for end, w in found if self.firsts else ():
                if w in self.firsts and end + 1 == len(self.words[w]):
                    seen[self.firsts[w]] = 1
            words.append(list(seen.items()))
            nears.append(near)
        return words, nears

    def scores(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts (rows) for the questions (columns), none where nothing matches, from what phrases weigh.

        A join adds up the parts that match; of a NOT, that is the first one.
        """
        there, total = np.zeros((n, self.columns), bool), np.zeros((n, self.columns))
        there[row, column] = True
        total[row, column] = value
        for kind, at, below, starts in self.steps:
            held, sums = there[:, below], np.where(there[:, below], total[:, below], 0.0)
            out = slice(at, at + len(starts))
            if kind == "not":
                there[:, out], total[:, out] = held[:, ::2] & ~held[:, 1::2], sums[:, ::2]
            else:
                joined = np.logical_and if kind == "and" else np.logical_or
                there[:, out], total[:, out] = joined.reduceat(held, starts, axis=1), np.add.reduceat(sums, starts, axis=1)
        return np.where(there[:, self.roots], np.round(total[:, self.roots], DIGITS), NONE)


def trigram_topk(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, grams: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The ``k`` best chunks of every question, an expression over substrings.

    Texts stay where they are. An automaton with the words of many questions goes to every task, which writes what it
    finds; that is counted and scored, and a task lets go only the ``k`` best of each question. Lengths are counted in trigrams; ``stats(n_chunks, avgchars)``, the number of chunks with text and
    their mean, saves a pass over all of them. With a kept index ``grams`` only the chunks that it names are read
    for words; without one all are. Ids are longs.
    """
    asked = written(expressions(questions))
    out = chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    n_chunks = avglen = None
    for lot in in_lots(asked):
        rows = lot.collect()
        if not rows:
            continue
        if n_chunks is None:
            n_chunks, avglen = (text_stats(chunks) if stats is None else stats).select("n_chunks", "avgchars").first()
        words = lot.select(F.explode("words").alias("word"))
        read = chunks if grams is None else candidates(chunks, words, grams)
        read = read.where(F.length("text") >= LEAST_WORD).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("text").alias("low"), (F.length("text") - 2).cast("double").alias("len"))
        out = out.unionByName(_scored(read, Asked(rows), k, n_chunks, avglen or 0.0))
    return top(out, k)


def text_stats(chunks: DataFrame) -> DataFrame:
    """``(n_chunks, avgchars)``: chunks with text, and their mean length in trigrams."""
    held = chunks.where(F.coalesce(F.col("text"), F.lit("")) != "")
    return held.agg(F.count("*").alias("n_chunks"), F.avg(F.greatest(F.length("text") - 2, F.lit(0))).alias("avgchars"))


def _pairs(found: list[list[tuple[int, int]]]) -> pa.ListArray:
    """Lists of (place, count) as a column."""
    ends = np.cumsum([0, *map(len, found)])
    flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["at", "n"]))


def _unpaired(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of such a column."""
    row = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))
    flat = column.flatten()
    return row, np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(float)


def _scored(texts: DataFrame, asked: Asked, k: int, n_chunks: int, avglen: float) -> DataFrame:
    """Every task's ``k`` best of ``texts(chunk_id, low, len)`` for the questions.

    Texts are searched once: what is found in them, a few numbers for each word or NEAR that a text holds, is written
    to the shared folder, where it is counted and then scored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = asked.automaton()
        for some in slices(batches):
            words, nears = asked.find(some.column(1).to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), _pairs(words), _pairs(nears)], names=["chunk_id", "len", "words", "nears"])

    pairs = "array<struct<at: int, n: int>>"
    found = written(texts.mapInArrow(find, f"chunk_id long, len double, words {pairs}, nears {pairs}").where(F.size("words") > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(asked.entities, np.int64)
        for some in slices(batches):
            n += np.bincount(_unpaired(some.column(0))[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["word", "n"])

    n = np.zeros(asked.entities)
    for r in found.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        n[r["word"]] = r["n"]
    weight = np.maximum(np.log((n_chunks - n + 0.5) / (n + 0.5)), LEAST_IDF)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, step = Best(k), max(1, best.CELLS // asked.columns)
        for batch in slices(batches):
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                row, entity, f = _unpaired(some.column(2))
                of, entry = spread(asked.ends, entity)
                near_row, near_column, near_f = _unpaired(some.column(3))
                row, column, f = np.append(row[of], near_row), np.append(asked.entry[entry], near_column), np.append(f[of], near_f)
                length = some.column(1).to_numpy()[row]
                value = weight[asked.of_leaf[column]] * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avglen)))
                kept.add(asked.scores(row, column, value, some.num_rows), some.column(0).to_numpy(), asked.queries)
        for q, c, s in kept.rows():
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["query_id", "chunk_id", "score"])

    return found.mapInArrow(score, "query_id long, chunk_id long, score double")


def search(chunks: DataFrame, index: Index, questions: DataFrame, k: int = TOP_K, grams: DataFrame | None = None, segmenter: Segmenter = T.bigrams, allowed: Column | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Keyword hits, and substring hits for the questions without any; ``path`` tells which.

    ``allowed`` speaks of ``chunks`` and filters both: a search's first 3k hits are filtered, and a question whose
    keyword hits are all filtered away asks for substrings.
    """
    files, wide = chunks.drop("text"), k if allowed is None else 3 * k
    exact = bm25_topk(index, questions, wide, segmenter)
    if allowed is not None:
        # Small, asked for twice: a few hits of each question.
        exact = written(filtered_topk(exact, files, allowed, k).select("query_id", "chunk_id", "score", "rank"))
        found = exact.select("query_id").distinct()
    else:
        # A question has a hit if one of its terms is in the index: no score is needed to tell.
        known = question_terms(questions, segmenter).join(index.vocabulary(), "term", "left_semi")
        found = known.select("query_id").distinct()
    near = trigram_topk(chunks, questions.join(found, "query_id", "left_anti"), wide, grams, stats)
    if allowed is not None:
        near = filtered_topk(near, files, allowed, k).select("query_id", "chunk_id", "score", "rank")
    return exact.withColumn("path", F.lit("terms")).unionByName(near.withColumn("path", F.lit("substrings")))
