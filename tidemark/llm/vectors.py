"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors collapse into a class; classes are dealt to shards by hash, and every shard's graph is
built in one task and written to the shared folder. Every class then queries its own shard, and of every two
shards the classes of one query the other, as a link found counts for both its ends: a task holds a
slice of the classes and reads the graphs from the shared folder one after another, so that vectors are
shuffled once, however many shards there are. Beams widen in two ways: a shard audits its graph against
brute force, with vectors of its own and of all shards that have links in it (themselves not counted), and
doubles its beam until the recall is reached; and a query whose beam is filled with links widens its own. A
widened beam that would cost more than a look at all of the shard becomes that look.
What a beam finds is checked in double precision before it counts; links become counts and spanning
forests where they are found, so pairs never leave a task.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, read_column, shuffle_partitions, written_by
from tidemark.llm.components import connected_components, spanning

THRESHOLD = 0.95
#: Links of a node on the ground layer (half to the nearest, half spread out) and above.
GROUND, UPPER = 32, 16
#: Shards at least, classes in a shard on average at most, classes per query task on average at most.
SHARDS, SHARD_ROWS, TASK_ROWS = 8, 50_000, 32_768
BEAM, BUILD_BEAM, EXPAND = 32, 48, 4
#: Nodes that a layer is entered by, and nodes of the topmost layer at most: all of them are looked at, and layers above it left out.
ENTRIES, FLAT = 8, 4096
#: Vectors with links that audit a shard at most; vectors of the shard, and of all shards, they are looked for among.
AUDITS, OWN_TRIED, ALL_TRIED, RECALL = 128, 1024, 256, 0.99
SLACK = 1e-4
#: Bytes of vectors that are looked up at once.
BLOCK_BYTES = 1 << 18
#: A widened beam of at least one in so many of a shard's vectors becomes a scan of the shard: a place in a beam takes as
#: long as some 3,000 vectors of a scan (9 us and 3 ns, 64 dimensions).
SCAN = 2048


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def similarities(x: np.ndarray, nodes: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Products of the rows ``nodes`` of ``x`` with the rows ``of`` of ``q``, a block that stays in the cache at a time."""
    out = np.empty(len(nodes), np.float32)
    block = max(1, min(len(nodes), BLOCK_BYTES // (4 * x.shape[1])))
    left, right = np.empty((block, x.shape[1]), x.dtype), np.empty((block, x.shape[1]), q.dtype)
    for at in range(0, len(nodes), block):
        n = min(block, len(nodes) - at)
        np.take(x, nodes[at : at + n], axis=0, out=left[:n], mode="clip")
        np.take(q, of[at : at + n], axis=0, out=right[:n], mode="clip")
        np.einsum("ij,ij->i", left[:n], right[:n], out=out[at : at + n])
    return out


def scan(q: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row of q, row of x) pairs with a product of at least ``least``, by products of blocks."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for top in range(0, len(q), 256):
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            i, j = np.divmod(np.flatnonzero((q[top : top + 256] @ part.T).ravel() >= least), len(part))
            a.append(i + top)
            b.append(j + at)
    return np.concatenate(a), np.concatenate(b)


def nearest(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of ``x`` (all, if fewer) nearest to each query, in no order: the way into a layer."""
    sims = q @ x.T
    k = min(k, len(x))
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def beam_search(q: np.ndarray, x: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and similarities of each query's beam, best first, all queries in step.

    ``links`` has a row of neighbours (-1: none) per node, ``entries`` a row of different start nodes per query.
    """
    n = len(q)
    seen = np.zeros(n * (len(x) + 1), bool)  # the first place of a query stands for "none"
    first = (np.arange(n) * (len(x) + 1) + 1)[:, None]
    seen[first[:, 0] - 1] = True
    k = entries.shape[1]
    width = max(beam, k)
    ids = np.full((n, width), -1, np.int32)
    best = np.full((n, width), -2.0, np.float32)
    done = np.ones((n, width), bool)
    there = entries >= 0
    seen[(first + entries)[there]] = True
    a, b = np.nonzero(there)
    ids[:, :k], done[:, :k] = entries, ~there
    best[a, b] = similarities(x, entries[a, b], q, a)
    live = np.arange(n)
    while len(live):
        # The best unexpanded members of every beam that still has any.
        score = np.where(done[live], -3.0, best[live])
        pick = np.argpartition(-score, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
        open_ = np.take_along_axis(score, pick, 1) > -3.0
        going = open_.any(axis=1)
        live, pick, open_ = live[going], pick[going], open_[going]
        if not len(live):
            break
        here = np.arange(len(live))[:, None]
        done[live[:, None], pick] = True
        nodes = ids[live[:, None], pick]
        near = np.where(open_[:, :, None], links[nodes], -1).reshape(len(live), -1)
        near[seen.take(first[live] + near)] = -1
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        at = np.flatnonzero(near.ravel() >= 0)
        new, row = near.ravel()[at], at // near.shape[1]
        of = live[row]
        seen[first[of, 0] + new] = True
        sims = similarities(x, new, q, of)
        # Only what is better than a beam's worst member can join it; it moves to the front of its row.
        at = np.flatnonzero(sims > best[live].min(axis=1)[row])
        new, row, sims = new[at], row[at], sims[at]
        col = np.arange(len(row)) - np.searchsorted(row, row)
        joins = np.full((len(live), int(col.max(initial=-1)) + 1), -1, np.int32)
        s = np.full(joins.shape, -2.0, np.float32)
        joins[row, col], s[row, col] = new, sims
        all_ids = np.concatenate([ids[live], joins], axis=1)
        all_best = np.concatenate([best[live], s], axis=1)
        all_done = np.concatenate([done[live], joins < 0], axis=1)
        top = np.argpartition(-all_best, width - 1, axis=1)[:, :width]
        ids[live], best[live], done[live] = all_ids[here, top], all_best[here, top], all_done[here, top]
    order = np.argsort(-best, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links per row from candidates, best first: the nearest, and then candidates that
    are nearer to the row than to any one chosen as spread out (or the nearest left over)."""
    n, k = ids.shape
    if k <= most:
        return np.pad(ids, ((0, 0), (0, most - k)), constant_values=-1)
    nearest = most // 2
    vecs = x[ids]
    between = vecs @ vecs.transpose(0, 2, 1)
    spread = np.zeros((n, k), bool)
    for j in range(k):
        blocked = (spread[:, :j] & (between[:, j, :j] > sims[:, j : j + 1])).any(axis=1)
        spread[:, j] = ~blocked & (ids[:, j] >= 0)
    rank = np.where(ids < 0, 3 * k, np.where(np.arange(k) < nearest, 0, np.where(spread, k, 2 * k))) + np.arange(k)
    top = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(ids, top, 1)


def connect(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Write the links of the new nodes and add the way back; a full node chooses among all it has."""
    links[new] = chosen
    most = links.shape[1]
    a, b = np.nonzero(chosen >= 0)
    to, of = chosen[a, b], new[a]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    for at in range(0, len(targets), 512):
        t, c = targets[at : at + 512], count[at : at + 512]
        extra = np.full((len(t), min(int(c.max()), 4 * most)), -1)
        rows = np.repeat(np.arange(len(t)), c)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(c) - c, c)
        src = of[first[at] : first[at] + len(rows)]
        fits = cols < extra.shape[1]
        extra[rows[fits], cols[fits]] = src[fits]
        ids = np.concatenate([links[t], extra], axis=1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.where(ids >= 0, (x[ids] @ x[t][:, :, None])[:, :, 0], -2.0)
        order2 = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
        ids, sims = np.take_along_axis(ids, order2, 1), np.take_along_axis(sims, order2, 1)
        links[t] = choose(x, ids, sims, most)


def build_layer(x: np.ndarray, most: int) -> np.ndarray:
    """Links of a small-world graph over the rows of ``x``, inserted in growing batches."""
    n = len(x)
    links = np.full((n, most), -1, np.int32)
    at = min(n, 256)
    sims = x[:at] @ x[:at].T
    np.fill_diagonal(sims, -2.0)
    ids = np.argsort(-sims, axis=1, kind="stable")[:, : min(2 * most, max(1, at - 1))]
    if at > 1:
        links[:at] = choose(x, ids, np.take_along_axis(sims, ids, 1), most)
    while at < n:
        new = np.arange(at, min(n, at + min(at, 512)))
        entries = nearest(x[new], x[: max(256, at // UPPER)], ENTRIES)
        ids, sims = beam_search(x[new], x[:at], links[:at], entries, BUILD_BEAM)
        # Nodes of one batch do not see each other in the graph: their own nearest join the candidates.
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -2.0)
        k = min(8, len(new) - 1)
        if k:
            near = np.argsort(-own, axis=1, kind="stable")[:, :k]
            ids = np.concatenate([ids, new[near]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        connect(x, links, new, choose(x, ids, sims, most))
        at = int(new[-1]) + 1
    return links


class Index:
    """A shard: raw vectors, their ids and weights, and the layers from the ground up."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, layers: list[np.ndarray], beam: int):
        self.ids, self.weights, self.raw, self.layers, self.beam = ids, weights, raw, layers, beam
        #: Links of the audit's vectors that there are, and those that were found with the beam settled on.
        self.audited = (0, 0)
        self.x = unit(raw.astype(np.float64))

    @classmethod
    def build(cls, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, threshold: float, others: tuple[np.ndarray, np.ndarray] | None = None) -> Index:
        """Nodes are numbered by height, highest first, so that every layer is a prefix of the one below.

        ``others`` are ids and vectors from all shards that join the audit.
        """
        draw = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in ids.tolist()], np.float64) / 2.0**64
        height = np.minimum(-np.log(np.maximum(draw, 1e-18)) / math.log(UPPER), 8).astype(int)
        order = np.lexsort((ids, -height))
        ids, weights, raw, height = ids[order], weights[order], raw[order], height[order]
        x = unit(raw.astype(np.float64))
        layers = [build_layer(x, GROUND)]
        for level in range(1, int(height.max()) + 1):
            n = int((height >= level).sum())
            layers.append(build_layer(x[:n], UPPER) if n > FLAT else np.empty((n, 0), np.int32))
            if n <= FLAT:
                break
        index = cls(ids, weights, raw, layers, BEAM)
        index.audit(threshold, others)
        return index

    def audit(self, threshold: float, others: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Double the beam until the tried vectors that have links in the shard find them.

        A vector's match with itself is no link. A shard in which none has any keeps its beam: ``audited`` is (0, 0).
        """
        own = np.unique(np.linspace(0, len(self.ids) - 1, OWN_TRIED).astype(int))
        ids, q = self.ids[own], self.x[own]
        if others is not None and len(others[0]):
            ids, q = np.concatenate([others[0], ids]), np.concatenate([unit(others[1].astype(np.float64)), q])
        exact = (q @ self.x.T >= threshold) & (ids[:, None] != self.ids[None, :])
        linked = np.flatnonzero(exact.any(axis=1))
        linked = linked[np.unique(np.linspace(0, max(0, len(linked) - 1), AUDITS).astype(int))] if len(linked) else linked
        q, exact = q[linked], exact[linked]
        there = int(exact.sum())
        while there:
            a, b = self.found(q, threshold)
            got = np.zeros_like(exact)
            got[a, b] = True
            self.audited = (there, int((got & exact).sum()))
            if self.audited[1] >= RECALL * there or self.beam >= len(self.ids):
                break
            self.beam *= 2

    def entries(self, q: np.ndarray) -> np.ndarray:
        """The ground's start nodes of each query: down the layers, from all nodes of the topmost one."""
        if len(self.layers) == 1:
            return np.zeros((len(q), 1), np.int64)
        entries = nearest(q, self.x[: len(self.layers[-1])], ENTRIES)
        for links in self.layers[-2:0:-1]:
            entries = beam_search(q, self.x[: len(links)], links, entries, ENTRIES)[0][:, :ENTRIES]
        return entries

    def found(self, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs that reach the threshold by single precision, less a little."""
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo, beam = np.arange(len(q)), self.beam
        while len(todo):
            if beam * SCAN >= len(self.x) and beam > BEAM or beam >= len(self.x):
                # A widened beam over much of the shard costs more than the whole shard at once.
                i, j = scan(q[todo], self.x, threshold - SLACK)
                a.append(todo[i])
                b.append(j)
                break
            wide = []
            for at in range(0, len(todo), 256):
                now = todo[at : at + 256]
                ids, sims = beam_search(q[now], self.x, self.layers[0], self.entries(q[now]), beam)
                good = (sims >= threshold - SLACK) & (ids >= 0)
                full = good.sum(axis=1) > beam // 2
                i, j = np.nonzero(good & ~full[:, None])
                a.append(now[i])
                b.append(ids[i, j])
                wide.append(now[full])
            todo, beam = np.concatenate(wide), 4 * beam
        return np.concatenate(a), np.concatenate(b)

    def links(self, ids: np.ndarray, raw: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of different ids whose cosine in double precision reaches the threshold."""
        a, b = self.found(unit(raw.astype(np.float64)), threshold)
        keep = ids[a] != self.ids[b]
        a, b = a[keep], b[keep]
        ok = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            p, r = raw[a[at : at + (1 << 16)]].astype(np.float64), self.raw[b[at : at + (1 << 16)]].astype(np.float64)
            dot = lambda u, v: np.einsum("ij,ij->i", u, v)
            ok[at : at + len(p)] = dot(p, r) / (np.sqrt(dot(p, p)) * np.sqrt(dot(r, r))) >= threshold
        return a[ok], b[ok]

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, weights=self.weights, raw=self.raw, beam=self.beam, **{f"layer{i}": x.astype(np.int32) for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Index:
        z = np.load(io.BytesIO(data))
        layers = [z[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in z.files))]
        return cls(z["ids"], z["weights"], z["raw"], layers, int(z["beam"]))


def meets(of: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Whether vectors of the shards ``of`` query ``shard``: of two shards one queries the other, and each itself."""
    ahead = (shard - of) % shards
    return (2 * ahead < shards) | (2 * ahead == shards) & (of < shard)


def _found(u: np.ndarray, v: np.ndarray | None, count: np.ndarray) -> pa.RecordBatch:
    """Links that connect u and v, or (without v) the numbers of links of u."""
    arrays = [pa.array(u), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v), pa.array(count)]
    return pa.RecordBatch.from_arrays(arrays, names=["u", "v", "count"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept, recall)``, one row per row of ``vectors``.

    ``recall`` is the share of links that the shards' audits found, the same in all rows (null: no audited vector
    has a link).

    Vectors that are null, empty or zero, or hold a null or non-finite number, link with nothing; so do
    vectors of different lengths with each other. Equal vectors link; rows that repeat a vec_id count as
    vectors of their own; rows with a null vec_id stay, without links. An empty table gives no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall("vec", number) & F.exists("vec", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    classes = cut(good.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("vec")))
    n = classes.count()
    shards = max(SHARDS, math.ceil(n / SHARD_ROWS))
    parts = shuffle_partitions(spark)
    slots = max(parts, math.ceil(n / TASK_ROWS))
    pack = "shard int, slot int, kind int, rep long, n long, dim int, data binary"

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(v, "<f8").tobytes() for v in batch.column(0).to_pylist()]
            reps = batch.column(1).to_pylist()
            hashes = [xxhash.xxh64_intdigest(str(r)) for r in reps]
            arrays = [
                pa.array([h % shards for h in hashes], pa.int32()),
                pa.array([(h >> 32) % slots for h in hashes], pa.int32()),
                pa.array([1] * len(reps), pa.int32()),
                *batch.columns[1:4],
                pa.array(data, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in pack.split(", ")])

    # Dealt by number: a hash of it would put several slots into one task, and several shards below.
    packed = cut(classes.mapInArrow(as_bytes, pack).repartitionById(slots, "slot"))
    # A bounded sample of all classes, for the audits.
    tried = packed.orderBy(F.xxhash64("rep"), "rep").limit(ALL_TRIED).select("rep", "dim", "data").collect()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for shard, rep, weight, dim, data in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6))):
                held.setdefault((shard, dim), []).append((rep, weight, data))
        for (shard, dim), got in held.items():
            raw = np.frombuffer(b"".join(g[2] for g in got), "<f8").reshape(len(got), dim)
            like = [r for r in tried if r["dim"] == dim]
            others = np.array([r["rep"] for r in like], np.int64), np.frombuffer(b"".join(bytes(r["data"]) for r in like), "<f8").reshape(len(like), dim)
            index = Index.build(np.array([g[0] for g in got]), np.array([g[1] for g in got]), raw, threshold, others)
            values = (shard, dim, *index.audited, index.dumps())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["shard", "dim", "there", "found", "data"])

    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    graphs = packed.repartitionById(shards, "shard").mapInArrow(build, "shard int, dim int, there long, found long, data binary")
    folder, indexes = written_by(graphs, "shard", "dim")
    # One row per shard: which graphs there are, and what their audits found.
    built = indexes.select("shard", "dim", "there", "found").collect()
    there = sum(r["there"] for r in built)
    recall = sum(r["found"] for r in built) / there if there else None
    shards_of: dict[int, list[int]] = {}
    for r in sorted(built, key=lambda r: r["shard"]):
        shards_of.setdefault(r["dim"], []).append(r["shard"])

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list, list]] = {}
        for batch in batches:
            for of, rep, weight, dim, data in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6))):
                for column, value in zip(held.setdefault(dim, ([], [], [], [])), (of, rep, weight, data)):
                    column.append(value)
        for dim, (of, ids, weights, raw) in held.items():
            of, ids, weights, raw = np.array(of), np.array(ids, np.int64), np.array(weights, np.int64), np.frombuffer(b"".join(raw), "<f8").reshape(len(ids), dim)
            count = np.zeros(len(ids), np.int64)
            for shard in shards_of[dim]:
                now = np.flatnonzero(meets(of, shard, shards))
                if not len(now):
                    continue
                index = Index.loads(read_column(f"{folder}/shard={shard}/dim={dim}", "data")[0])
                q, node = index.links(ids[now], raw[now], threshold)
                q = now[q]
                count += np.bincount(q, index.weights[node], len(ids)).astype(np.int64)
                u, v = spanning(ids[q], index.ids[node])
                yield _found(u, v, np.zeros(len(u), np.int64))
                # Vectors of another shard are not looked for from here: what finds them counts for them too.
                other = of[q] != shard
                back = np.bincount(node[other], weights[q[other]], len(index.ids)).astype(np.int64)
                met = np.flatnonzero(back)
                yield _found(index.ids[met], None, back[met])
            linked = np.flatnonzero(count)
            yield _found(ids[linked], None, count[linked])

    found = cut(packed.mapInArrow(query, "u long, v long, count long"))
    parts_of = connected_components(found.where("v is not null").select("u", "v"))
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("count").alias("links"))
    named = (
        classes.join(counts, "rep", "left")
        .join(parts_of, F.col("rep") == F.col("node"), "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    known = good.join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("recall", F.lit(recall).cast("double"))
