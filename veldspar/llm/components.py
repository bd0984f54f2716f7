"""Connected components of an edge list, without gathering any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.store import settle

#: Edges that a task contracts at a time.
EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges but for the smallest of each component, and that smallest one."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(names)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x < y:
            up[y] = x
        else:
            up[x] = y
    top = np.array(up, np.int64)
    while (top[top] != top).any():
        top = top[top]
    below = np.flatnonzero(top != np.arange(len(top)))
    return names[below], names[top[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has of the edges, as stars around the smallest nodes: it connects the same nodes by fewer edges."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        child, parent = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(parent, pa.int64())], names=["child", "parent"])

    for batch in batches:
        if len(batch):
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += len(batch)
        if size > EDGES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b: long, not null), as node, component.

    Each task first makes stars of the edges it has. Then edges point from a node to a smaller one, and each round moves them in two
    steps: a node's larger neighbours
    go to the smallest of its neighbourhood (large star), then its smaller neighbours and itself go to
    the smallest of these (small star). Neither parts a component nor adds edges, and rounds grow with the
    logarithm of the number of nodes, however doc_ids lie along a chain. The loop ends only when each
    component is a star around its smallest node. Minima combine before they are shuffled, so a node
    with very many neighbours is no bottleneck.
    """
    held = settle(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "child long, parent long").distinct())
    while True:
        ends = held.select(F.col("child").alias("node"), F.col("parent").alias("other"), F.lit(1).alias("up")).union(
            held.select(F.col("parent").alias("node"), F.col("child").alias("other"), F.lit(0).alias("up"))
        )
        around = settle(
            ends.groupBy("node").agg(F.min("other").alias("m"), F.sum("up").alias("parents"), F.count(F.lit(1)).alias("n"))
            .select("node", F.least("node", "m").alias("least"), ((F.col("parents") > 0) & (F.col("n") > 1)).alias("open"))
        )
        if not around.agg(F.max("open")).first()[0]:
            return around.select("node", F.col("least").alias("component"))
        # Most neighbours of a node are told the same; each task sends it once.
        large = held.join(around, held["parent"] == around["node"]).select("child", F.col("least").alias("parent")).distinct()
        low = large.groupBy("child").agg(F.min("parent").alias("least"))
        moved = large.join(low, "child").filter("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        held = settle(moved.union(low.select("child", F.col("least").alias("parent"))).distinct())
