"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One round over edges ``(u, v)`` with ``u > v``.

    Every neighbour of ``u`` (the larger ones if ``both_ways``, else the smaller ones and ``u``) is
    linked to the smallest node next to ``u``.
    """
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = arcs.join(least, "u")
    if both_ways:
        new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = new.unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u long, v long)``; component = smallest node.

    Only edges move, by shuffles; each round is checkpointed, so a lost executor costs one round at
    most and nothing reaches the driver but two counts. Self-loops, repeated and null edges are
    ignored; an edge table without edges gives no rows.
    """
    edges = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, True), False))
        # A forest of stars is stable: no node both has a parent and is one.
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the given links connect."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
