"""Connected components by alternating large-star and small-star steps; each partition joins its own edges first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, by hooking and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


#: Edges that a task joins at a time (16 bytes each).
SOME = 4_000_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: in each partition, each node's to the least that its edges there reach."""

    def join(batches):
        held, size = [], 0

        def out():
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            node, root = _joined(a, b)
            far = node != root
            return C.batch_of("a long, b long", [node[far], root[far]])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= SOME:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.select("a", "b").mapInArrow(C.tidied(join), "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("is_root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("is_root")))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("is_root").alias("is_root")).filter("n > 1 OR (n > 0 AND is_root > 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Each round is written, so lineage stays short; rounds go with the logarithm of the nodes at
    most, and there are none where one partition holds all edges.
    """
    now = C.written(_contracted(edges.filter("a <> b")))
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        new = C.written(_contracted(_small_star(_large_star(now))))
        C.dropped(now)
        now = new
    raise RuntimeError("components did not settle")
