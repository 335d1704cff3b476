"""Vector code compression: product quantisation with a partial-distance search.

Components become integers, vectors are cut into equal parts, and every part is replaced by the number of the
nearest entry of its position's codebook. The search goes through a part's dimensions in the order of the
codebook's variance, largest first, and a mask lets go an entry as soon as its integer distance so far strictly
exceeds the least complete distance known: what is nearest, and which entries tie, never changes by it.
Codebooks are refined in a fixed number of rounds; a task sends one sum per entry and component to a shuffle,
and the driver holds the codebooks (entries times dimensions) alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import smallest, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Pairs of vectors and entries that are compared at once.
PAIRS = 1 << 20
#: A label with more than this share of the rows is joined by a broadcast: there are at most its reciprocal of them.
HOT_SHARE = 1e-4


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]`` as 64-bit integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def orders(self) -> list[np.ndarray]:
        """Each part's dimensions by descending variance of its entries, ties in their own order."""
        out = []
        for book in self.entries.astype(object):
            spread = len(book) * (book * book).sum(axis=0) - book.sum(axis=0) ** 2
            out.append(np.array(sorted(range(book.shape[1]), key=lambda j: (-spread[j], j)), int))
        return out


def nearest(x: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row of ``x`` (ties: the lower one) and its squared distance.

    The entry that is nearest in the first dimension gives a row's first complete distance; entries beyond it
    go as soon as they are, equal ones stay to the end.
    """
    n, step = len(x), max(1, PAIRS // max(1, len(book)))
    if n > step:
        found = [nearest(x[a : a + step], book, order) for a in range(0, n, step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    first = np.square(x[:, order[0], None] - book[None, :, order[0]])
    best = np.square(x - book[first.argmin(axis=1)]).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    far = first[row, entry]
    for j in order[1:]:
        far = far + np.square(x[row, j] - book[entry, j])
        near = far <= best[row]
        row, entry, far = row[near], entry[near], far[near]
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(far, starts)
    hit = np.flatnonzero(far == least[row])
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], least


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, vector array<double>)`` without null vectors and those with null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vector").isNotNull() & sound)


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Vectors as rows of ``floor(scale * x)``; missing components at a vector's end are 0."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(column), dims), np.int64)
    # The largest size at which the squared distances of whole vectors stay below 2^63.
    most = math.isqrt((1 << 63) // dims) // 2 - 1
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(scale * flat), -most, most).astype(np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def first_codebooks(rows: DataFrame, dims: int, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    chosen = smallest(rows.select("vec_id", "vector"), entries, F.asc_nulls_last("vec_id"), F.asc("vector")).collect()
    held = integers(pa.array([r["vector"] for r in chosen], pa.list_(pa.float64())), dims, scale)
    return Codebooks(held.reshape(len(held), parts, dims // parts).transpose(1, 0, 2).copy())


def refined(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """Every entry becomes the floored mean of the parts nearest to it; entries that no part is nearest to stay."""
    parts, entries, width = books.entries.shape
    orders = books.orders()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(0), parts * width, scale).reshape(-1, parts, width)
            for p in range(parts):
                of, _ = nearest(x[:, p], books.entries[p], orders[p])
                np.add.at(total[p], of, x[:, p])
                n[p] += np.bincount(of, minlength=entries)
        p, e = np.nonzero(n)
        at = np.tile(np.arange(width), len(p))
        columns = [np.repeat(p, width), np.repeat(e, width), at, total[p, e].ravel(), np.repeat(n[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "total", "n"])

    sums = rows.select("vector").mapInArrow(run, "part long, entry long, at long, total long, n long")
    # One row per entry and component: as many as the codebooks have numbers.
    means = sums.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    new = books.entries.copy()
    for r in means:
        new[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(new)


def coded(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """``(vec_id, label, code, error)``: entry numbers as two hex digits a part, squared distances summed over parts."""
    parts, _, width = books.entries.shape
    orders = books.orders()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), parts * width, scale).reshape(-1, parts, width)
            if not len(x):
                continue
            found = [nearest(x[:, p], books.entries[p], orders[p]) for p in range(parts)]
            text = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "vector", "label").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``label_error``: ``error`` summed over equal labels, nulls together; null where it exceeds 64 bits.

    Labels of a large share of the rows (at most 1 / ``HOT_SHARE`` of them) are joined by a broadcast, the others
    by a shuffle in which none of them is large.
    """
    keyed = rows.withColumn("_label", F.struct("label"))
    sums = written(keyed.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")))
    least = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * HOT_SHARE
    total = F.expr("try_cast(total as bigint)")
    hot = sums.where(F.col("n") > least).select("_label", total.alias("hot_error"), F.lit(True).alias("hot"))
    rest = sums.where(F.col("n") <= least).select("_label", total.alias("label_error"))
    dealt = keyed.join(F.broadcast(hot), "_label", "left")
    joined = dealt.where("hot is null").drop("hot", "hot_error").join(rest, "_label").unionByName(dealt.where("hot").drop("hot").withColumnRenamed("hot_error", "label_error"))
    return joined.drop("_label")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """``(vec_id, label, code, error, label_error)`` of every usable vector, and the codebooks behind the codes.

    Rows with a null vector or a null or non-finite component are left out; so an empty table, or one of such rows
    only, gives no rows and empty codebooks. Codebooks start from the ``entries`` (256 at most) smallest ids, ids
    that are null after all others and equal ids in the order of their vectors; fewer rows make fewer entries.
    Repeated rows are coded and counted like others, rows without a label make up one label. Vectors shorter than
    the longest, and lengths that ``parts`` does not divide, count as filled up with zeros. ``floor(scale * x)``
    saturates where squared distances of whole vectors could leave 64 bits (beyond some 190 million for 64
    dimensions). Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = usable(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    books = first_codebooks(rows, parts * max(1, math.ceil(longest / parts)), parts, entries, scale)
    for _ in range(rounds):
        books = refined(rows, books, scale)
    return with_label_error(written(coded(rows, books, scale))), books


#: The contract's numbers; codebooks of each round from the assignment to those before.
ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 16 AS width
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT vec_id, label, p, list_slice(v, p * width + 1, (p + 1) * width) AS x
  FROM kept, (SELECT unnest(range(16)) AS p)
),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
book0 AS (SELECT p, e, x AS c FROM parts JOIN seeds USING (vec_id)),
{rounds}
last AS (
  SELECT vec_id, label, p, min({{d: {distance}, e: e}}) AS best
  FROM parts JOIN book2 USING (p) GROUP BY vec_id, label, p
),
codes AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM last GROUP BY vec_id, label
),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes, digest
""".strip()
_DISTANCE = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_ROUND = """
near{i} AS (
  SELECT vec_id, p, any_value(x) AS x, min({{d: {distance}, e: e}}).e AS e
  FROM parts JOIN book{i} USING (p) GROUP BY vec_id, p
),
mean{i} AS (
  SELECT p, e, list(m ORDER BY j) AS c
  FROM (SELECT p, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m
        FROM near{i}, (SELECT unnest(range(1, 1 + (SELECT max(width) FROM kept))) AS j) GROUP BY p, e, j)
  GROUP BY p, e
),
book{j} AS (SELECT p, e, coalesce(mean{i}.c, book{i}.c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, e)),
""".strip()
ORACLE_SQL = ORACLE_SQL.format(distance=_DISTANCE, rounds="\n".join(_ROUND.format(i=i, j=i + 1, distance=_DISTANCE) for i in range(ROUNDS)))
