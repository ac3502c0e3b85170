"""Connected components of an undirected graph: bounded parts contracted, then large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts, about 4 MB; a graph of no more is settled by that alone.
PART = 1 << 18


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node of the edges (u, v): the least node that it is joined to. Roots are
    hooked to lesser ones and paths halved until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]


def _contract(batches):
    """The edges of a part as a star a component: (node, least node of it within this part)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, root = least_reachable(*(np.concatenate(c) for c in zip(*held, strict=True)))
        apart = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(root[apart])], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Each node's least neighbour is a partial aggregate; it returns to the edges
    through an equi-join that Spark may split, so that a hub is never one task's work."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 100, part: int = PART) -> DataFrame:
    """(node, root) of each node, a long, that has an edge; root is the least node of its component.

    Self-loops and null ends are no edges; repeated edges count once; no edges give no rows. Each
    round first contracts parts of about `part` edges, one in a task, to stars; what is one
    part is then done. A larger graph goes through a round of large and small stars, which end
    when the edges no longer change; their number grows with the logarithm of the longest path.
    Every round is written to the shared folder. Raises if the graph has not settled after
    `max_rounds`.
    """
    a, b = F.col(left), F.col(right)
    now = cut(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(a.cast("long").alias("u"), b.cast("long").alias("v")))
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        parts = -(-state[0] // part)
        if parts <= 1 or state == seen:
            break
        seen = state
        now = cut(_star(_star(now.coalesce(parts).mapInArrow(_contract, "u long, v long"), True), False))
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    if parts <= 1:
        now = now.coalesce(1).mapInArrow(_contract, "u long, v long")
    now = cut(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
