"""Transitive closure of undirected links (D11): labels of connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes whose trees ``spanning_links`` remembers in a task.
TREE_NODES = 1_000_000


def connected_components(edges: DataFrame, src: str, dst: str, save: Callable[[DataFrame], DataFrame], max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node that has a link; label is the smallest node of its component.

    Alternates large-star and small-star steps, which need a number of rounds
    logarithmic in the component size and keep at most as many edges as they
    were given. ``save`` cuts the lineage of a round (it writes and rereads).
    Null ends and self-links are ignored. Raises if it has not converged.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    state = save(pairs.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    if state.isEmpty():
        return state.select(F.col("u").alias("node"), F.col("v").alias("label"))
    seen = None
    for _ in range(max_rounds):
        state = save(_small_star(_large_star(state)))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = now
    raise RuntimeError(f"components have not converged in {max_rounds} rounds")


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, itself included."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the node's smallest neighbour."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


class Trees:
    """Which of the numbers 0 to n - 1 are tied together so far."""

    def __init__(self, n: int):
        import numpy as np

        self.root = np.arange(n)

    def tie(self, i, j):
        """The places in ``i`` and ``j`` (arrays of links) of those that tie what was not tied."""
        import numpy as np

        apart = np.flatnonzero(self.root[i] != self.root[j])
        root, new = self.root, []
        for k, x, y in zip(apart.tolist(), root[i[apart]].tolist(), root[j[apart]].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                new.append(k)
        self.settle()
        return np.array(new, dtype=np.int64)

    def settle(self) -> None:
        while ((up := self.root[self.root]) != self.root).any():
            self.root = up


def spanning_links(edges: DataFrame) -> DataFrame:
    """Links (a, b) of whole numbers with the components of ``edges``: a task leaves out what ties nothing new.

    A task returns fewer links than it meets nodes. What it knows is bounded: past TREE_NODES it begins anew.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        nodes, roots = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            ends, at = np.unique(np.concatenate([nodes, roots, a, b]), return_inverse=True)
            trees, n = Trees(len(ends)), len(nodes)
            trees.root[at[:n]] = at[n : 2 * n]  # roots are the smallest nodes of their trees, as in ``tie``
            new = trees.tie(at[2 * n : 2 * n + len(a)], at[2 * n + len(a) :])
            yield pa.record_batch([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])
            nodes, roots = (ends, ends[trees.root]) if len(ends) <= TREE_NODES else (nodes[:0], roots[:0])

    sound = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    return sound.mapInArrow(run, "a long, b long")
