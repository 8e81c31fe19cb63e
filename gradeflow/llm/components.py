"""Connected components of a graph that is a DataFrame of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, dropped, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and for each the smallest node it is joined with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _local(batches: Batches) -> Batches:
    """Replace the edges of each batch by stars with the same components."""
    for batch in batches:
        node, root = forest(*(batch.column(k).to_numpy() for k in (0, 1)))
        yield pa.RecordBatch.from_pydict({"a": node, "b": root})


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges`` (a long, b long) -> (node, component), the smallest node reachable.

    Each round points every node to its least neighbour, follows pointers of pointers, and draws
    the edges that are left between what the nodes point to, so edges inside a group are gone
    after the round that gathers it and the rounds grow with the logarithm of a chain's
    length. Sums and joins only: a hub with a third of all edges is combined before the
    shuffle. Edges and pointers are written to the shared folder each round and deleted after
    their last use. Nodes without an edge to another node have no row; null ends are dropped.
    """
    plain = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    left = written(plain.mapInArrow(_local, "a long, b long").where("a <> b").distinct(), tag)
    if left.isEmpty():
        out = written(left.selectExpr("a as node", "b as component"), tag)
        dropped(left)
        return out
    steps = []
    while not left.isEmpty():
        least = left.selectExpr("explode(array(struct(a as node, b as near), struct(b as node, a as near))) as e").select("e.*").groupBy("node").agg(F.min("near").alias("near"))
        one = written(least.selectExpr("node", "least(node, near) as goes"), tag)
        ahead = one.select(F.col("node").alias("t"), F.col("goes").alias("next"))
        points = written(one.join(ahead, one.goes == ahead.t).selectExpr("node", "next as goes"), tag)
        steps.append(points)
        from_a = left.join(points, left.a == points.node).selectExpr("goes as a", "b")
        drawn = from_a.join(points, from_a.b == points.node).selectExpr("a", "goes as b").where("a <> b")
        rest = written(drawn.selectExpr("greatest(a, b) as a", "least(a, b) as b").mapInArrow(_local, "a long, b long").where("a <> b").distinct(), tag)
        dropped(left, one)
        left = rest
    out = steps[0].selectExpr("node", "goes as component")
    for points in steps[1:]:
        later = points.select(F.col("node").alias("t"), F.col("goes").alias("next"))
        out = out.join(later, out.component == later.t, "left").selectExpr("node", "coalesce(next, component) as component")
    out = written(out, tag)
    dropped(left, *steps)
    return out
