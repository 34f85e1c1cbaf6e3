"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.scratch import discard, settle, settle_measured

#: Edges that a task joins at once; a larger partition is joined in pieces.
CHUNK = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, root`` of every node that is not its component's smallest, from the edges of one piece."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(parent, high[apart], low[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _local(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` of the same components: a star for each component of a partition's own edges.

    No shuffle; keys other than long integers are left as they are.
    """
    if {kind for _, kind in edges.dtypes} != {"bigint"}:
        return edges

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(*ends)], names=["u", "v"])

    return edges.mapInArrow(join, "u long, v long")


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours on the smallest node of each neighbourhood.

    ``larger_only`` is the large step (all edges, larger neighbours move); otherwise the small step
    (edges to smaller neighbours, which move together with the node). Minima come from a grouped
    aggregate and a join, so that a hub's neighbourhood is split over tasks.
    """
    if larger_only:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        moved = both.join(lows, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lows = down.groupBy("u").agg(F.min("v").alias("low"))
        hung = down.join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = hung.unionByName(lows.select("u", F.col("low").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with an edge to another; ``root`` is its component's smallest.

    Self-loops, repeated edges and null ends are ignored. First the edges of each partition are joined by
    themselves. A round takes both star steps; it is written to the scratch folder, and its checksums are
    measured by that write. The loop ends when a round changes nothing, in about ``log`` of the longest
    path rounds.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    now, mark = settle(_local(ends), "links"), None
    for _ in range(max_rounds):
        before = now
        now, seen = settle_measured(
            _star(_star(before, True), False),
            "stars",
            n=F.count(F.lit(1)),
            mix=F.bit_xor(F.xxhash64("u", "v")),
            total=F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1_000_000_007))),
        )
        discard(before)
        if seen == mark or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = seen
    raise RuntimeError("components did not settle")
