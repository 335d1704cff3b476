"""Vector operators: encoding, exact top-k in blocks, the embedding cache and small vector functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.best import CELLS, Best
from tidemark.sources.shared import written

TOP_K = 20
#: Questions that come to a task together, on average; the answer does not depend on it.
BLOCK = 4096
DIMS = 64
#: Fixed value: what a question is prefixed with before it is encoded.
INSTRUCTION = "Retrieve relevant text passages that answer the query."


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """The vector over its length; zero vectors stay."""
    # The length is bound as a variable: inside the inner function it would be worked out for every component.
    over = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.element_at(F.transform(F.array(norm(a)), over), 1)


def probability_of_yes(yes: Column, no: Column) -> Column:
    """First component of the softmax of two logits."""
    top = F.greatest(yes, no)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))


def position_ids(mask: Column) -> Column:
    """Running count of the mask less one where it is set, 0 elsewhere."""
    upto = lambda i: F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x)
    return F.transform(mask, lambda m, i: F.when(m == 1, upto(i) - 1).otherwise(0))


def adaptive_batch(n: Column, average: Column, budget: int, most: int) -> Column:
    """Texts per encoder call: a budget of characters over their average, between 1 and ``most``, at most ``n``."""
    by_budget = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), average)))
    return F.least(n, F.least(F.lit(most), F.greatest(F.lit(1), by_budget)))


def encoder_key(backend: str, model: str, provider: str = "", optimization: str = "", quantization: str = "") -> str:
    """Name under which an encoder's vectors are cached."""
    parts = [backend, model, provider, f"opt={optimization}" if optimization else "", f"quant={quantization}" if quantization else ""]
    return "::".join(p for p in parts if p)


def question_text(question: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {INSTRUCTION}\nQuery: "), question)


def encode(texts: DataFrame, dims: int = DIMS) -> DataFrame:
    """``texts(key, text)`` to ``(key, vector array<float>)``: the default encoder, hashed words, unit length.

    It stands in for a model and keeps its contract: fixed length, unit norm, the same text the
    same vector. Texts without a word get the first axis.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zlib

        word = re.compile(r"\w+")
        for batch in batches:
            out = np.zeros((batch.num_rows, dims), np.float32)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for w in word.findall((text or "").lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % dims] += 1 if h & 0x80000000 else -1
            out[~out.any(axis=1), 0] = 1
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dims).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["key", "vector"])

    return texts.select(F.col("key").cast("string").alias("key"), "text").mapInArrow(run, "key string, vector array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def question_blocks(questions: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of ``questions(query_id, vector)``, ``BLOCK`` of them together on average."""
    asked = written(questions.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector"))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if rows:
            yield np.array([r["query_id"] for r in rows], np.int64), unit(np.array([r["vector"] for r in rows], float))


def ranked(near: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every question of what tasks let go, ties by chunk_id; ``rank`` counts from 0."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long") - 1)


def topk(vectors: DataFrame, questions: DataFrame, k: int = TOP_K, digits: int = 6, allowed: Column | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the ``k`` nearest by cosine, exactly, ties by chunk_id.

    ``vectors(chunk_id, vector, ...)`` stay in their tasks and are not shuffled; questions ``(query_id, vector)``
    come to every task, a block of bounded size at a time, and a task lets go each question's ``k`` best.
    ``allowed`` filters the corpus before the search. Null vectors are near nothing.
    """
    corpus = (vectors if allowed is None else vectors.where(allowed)).where("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector")
    out = vectors.sparkSession.createDataFrame([], NEAR)
    for ids, q in question_blocks(questions):
        out = out.unionByName(_nearest(corpus, ids, q, None, k, digits))
    return ranked(out, k)


NEAR = "query_id long, chunk_id long, score double"


def _nearest(corpus: DataFrame, ids: np.ndarray, q: np.ndarray, of_list: dict[int, np.ndarray] | None, k: int, digits: int) -> DataFrame:
    """Every task's ``k`` nearest of each question; with ``of_list``, a list's vectors meet its questions only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, step = Best(k), max(1, CELLS // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                x, chunk = unit(matrix(some.column(1))), some.column(0).to_numpy()
                if of_list is None:
                    kept.add(np.round(x @ q.T, digits), chunk, ids)
                    continue
                of = some.column(2).to_numpy()
                for n in np.unique(of):
                    here, asked = np.flatnonzero(of == n), of_list.get(int(n))
                    if asked is not None:
                        kept.add(np.round(x[here] @ q[asked].T, digits), chunk[here], ids[asked])
        for found in kept.rows():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "chunk_id", "score"])

    return corpus.mapInArrow(run, NEAR)


#: Vectors that lists are trained on (on average), lists at most, and rounds of training.
SAMPLE, MOST_LISTS, ROUNDS = 1 << 18, 1 << 14, 12
#: Vectors of the sample that a task trains on, on average.
TASK_ROWS = 1 << 13
#: The list of vectors that were stored before there were any: it is always read.
NO_LIST = -1


def no_centroids() -> np.ndarray:
    return np.zeros((0, 0))


def train_lists(vectors: DataFrame, lists: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centroids for an inverted file, by k-means on a sample picked by a hash of the ids; none without vectors.

    The square root of the number of vectors makes as many lists as lists have vectors. Zero vectors don't train.
    The sample is written once, in as many parts as it asks for, and the rounds read that.
    """
    held = vectors.where("vector is not null").select("chunk_id", "vector").where(norm(F.col("vector")) > 0)
    n = held.count()
    if not n:
        return no_centroids()
    share = max(1, math.ceil(n / SAMPLE))
    sample = held.where(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0) if share > 1 else held
    rows = written(sample.select(array_to_vector(l2_normalized(F.col("vector"))).alias("features")).repartition(math.ceil(min(n, SAMPLE) / TASK_ROWS)))
    wanted = lists or min(MOST_LISTS, math.ceil(math.sqrt(n)))
    model = KMeans(k=max(2, wanted), seed=seed, maxIter=ROUNDS, distanceMeasure="cosine").fit(rows)
    return unit(np.array(model.clusterCenters()))


def with_list(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors(chunk_id, vector, ...)`` with ``list``, the nearest centroid's number (zero vectors: some list)."""
    if not len(centroids):
        return vectors.drop("list").withColumn("list", F.lit(NO_LIST))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = StructType([f for f in vectors.schema if f.name != "list"]).add("list", "integer")
    at = [f.name for f in vectors.schema if f.name != "list"].index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        step = max(1, CELLS // len(c))
        for batch in batches:
            of = [(unit(matrix(batch.column(at).slice(a, step))) @ c.T).argmax(axis=1) for a in range(0, batch.num_rows, step)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(of) if of else [], pa.int32())], names=[f.name for f in schema])

    return vectors.drop("list").mapInArrow(run, schema)


def _listed(corpus: DataFrame, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int, digits: int) -> DataFrame:
    """Every task's ``k`` nearest of each question among the lists it asks (``asked[question, list]``) and the vectors
    without a list. Only those lists are read, as far as files are sorted by them."""
    of_list = {int(n): np.flatnonzero(asked[:, n]) for n in np.flatnonzero(asked.any(axis=0))} | {NO_LIST: np.arange(len(ids))}
    read = corpus.where(F.col("list").isin(*sorted(of_list))) if len(of_list) <= asked.shape[1] // 2 else corpus
    return _nearest(read, ids, q, of_list, k, digits)


def _first_lists(q: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    asked = np.zeros((len(q), len(centroids)), bool)
    np.put_along_axis(asked, np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes], True, axis=1)
    return asked


def probe(listed: DataFrame, questions: DataFrame, centroids: np.ndarray, probes: int, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """The ``k`` nearest of every question among the vectors of its ``probes`` nearest lists (``listed`` has them) and
    those without one. Scores are exact."""
    corpus = listed.where("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector", "list")
    out = listed.sparkSession.createDataFrame([], NEAR)
    for ids, q in question_blocks(questions):
        asked = _first_lists(q, centroids, probes) if len(centroids) else np.zeros((len(ids), 0), bool)
        out = out.unionByName(_listed(corpus, ids, q, asked, k, digits))
    return ranked(out, k)


def indexed_topk(listed: DataFrame, questions: DataFrame, centroids: np.ndarray, probes: int = 4, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """``topk`` by way of the lists, and as exact: a question's nearest lists give it ``k`` scores, and then it reads
    every list that can hold a better one, by the angle of the list's farthest member. Zero vectors are read always."""
    if not len(centroids):
        return topk(listed, questions, k, digits)
    corpus = listed.where("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector", F.when(norm(F.col("vector")) > 0, F.col("list")).otherwise(NO_LIST).alias("list"))
    reach = np.ones(len(centroids))
    for r in least_cosines(corpus.where(F.col("list") != NO_LIST), centroids).collect():
        reach[r["list"]] = r["least"]
    out = listed.sparkSession.createDataFrame([], NEAR)
    for ids, q in question_blocks(questions):
        first = ranked(_listed(corpus, ids, q, _first_lists(q, centroids, probes), k, digits), k)
        floors = {r["query_id"]: r["score"] for r in first.where(F.col("rank") == k - 1).select("query_id", "score").collect()}
        angle = np.maximum(0, np.arccos(np.clip(q @ centroids.T, -1, 1)) - np.arccos(np.clip(reach, -1, 1)))
        asked = np.cos(angle) + 10.0**-digits >= np.array([floors.get(int(i), -1.0) for i in ids])[:, None]
        out = out.unionByName(_listed(corpus, ids, q, asked, k, digits))
    return ranked(out, k)


def least_cosines(listed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(list, least)``: the least cosine of a list's members to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(centroids), 2.0)
        for batch in batches:
            of = batch.column(1).to_numpy()
            np.minimum.at(least, of, (unit(matrix(batch.column(0))) * centroids[of]).sum(axis=1) if len(of) else 0.0)
        at = np.flatnonzero(least < 2)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(least[at])], names=["list", "least"])

    return listed.select("vector", "list").mapInArrow(run, "list int, least double").groupBy("list").agg(F.min("least").alias("least"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, wanted, got)``: how many of the exact hits of a question were found."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("got"))


def probes_for(listed: DataFrame, questions: DataFrame, centroids: np.ndarray, least: float = 0.9, k: int = TOP_K) -> tuple[int, float]:
    """The lists a question has to probe, doubled until the share of the exact hits that is found is ``least``, and that share."""
    exact = written(topk(listed, questions, k))
    probes = 1
    while True:
        wanted, got = recall(probe(listed, questions, centroids, probes, k), exact).agg(F.sum("wanted"), F.sum("got")).first()
        share = got / wanted if wanted else 1.0
        if share >= least or probes >= len(centroids):
            return probes, share
        probes = min(2 * probes, len(centroids))


def cache_plan(chunks: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``(text_hash, times, cached)`` of every distinct text: what an ingest asks the cache for."""
    hashes = chunks.select(F.sha2("text", 256).alias("text_hash")).groupBy("text_hash").agg(F.count("*").alias("times"))
    known = cache.where(F.col("model_name") == key).select("text_hash", F.lit(True).alias("hit"))
    return hashes.join(known, "text_hash", "left").select("text_hash", "times", F.coalesce("hit", F.lit(False)).alias("cached"))


def cache_counts(plan: DataFrame) -> DataFrame:
    """Hits and misses count chunks, ``to_encode`` counts distinct texts."""
    hits = F.coalesce(F.sum(F.when(F.col("cached"), F.col("times"))), F.lit(0))
    misses = F.coalesce(F.sum(F.when(~F.col("cached"), F.col("times"))), F.lit(0))
    return plan.agg(hits.alias("cache_hits"), misses.alias("cache_misses"), F.count(F.when(~F.col("cached"), 1)).alias("to_encode"))


def encode_with_cache(chunks: DataFrame, cache: DataFrame, key: str, encoder=encode) -> tuple[DataFrame, DataFrame]:
    """``(chunk_id, vector)`` of all chunks, and the rows that the cache gains; each distinct text is encoded once."""
    hashed = chunks.select("chunk_id", "text", F.sha2("text", 256).alias("text_hash"))
    known = cache.where(F.col("model_name") == key).select("text_hash", "vector")
    missing = hashed.join(known, "text_hash", "left_anti").groupBy("text_hash").agg(F.first("text").alias("text"))
    gained = encoder(missing.select(F.col("text_hash").alias("key"), "text")).select(F.lit(key).alias("model_name"), F.col("key").alias("text_hash"), "vector")
    every = known.unionByName(gained.select("text_hash", "vector"))
    return hashed.join(every, "text_hash").select("chunk_id", "vector"), gained
