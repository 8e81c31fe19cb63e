"""Nearest neighbours with a vantage-point tree for each shard (operator 1).

Vectors are scaled to length one, where the largest cosine is the smallest Euclidean
distance, and dealt to shards by their id. Each shard is a tree: a node keeps a vantage point
and the median distance to it, near points on one side, far ones on the other. A side is passed
over if the triangle inequality puts it beyond the k-th distance found so far; ``factor``
multiplies that bound, so that above one more is passed over and some neighbours may be
missed, and one is exact. What may be among the k best is measured on the original vectors at
once. Queries are cut into blocks too: a task holds one shard and one block.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches
from gradeflow.llm.vectors import by_task, cosines, matrix, runs, shard_count, shard_of, unit, usable_vectors

LEAF = 256
SLACK = 1e-9  # what a product of unit vectors may differ from the final measure
BLOCK = 1 << 16  # pairs measured at once


class VPTree:
    def __init__(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vecs = ids[order], vecs[order]
        self.units = unit(self.vecs)
        self.root = self._node(np.arange(len(ids)), np.random.default_rng(len(ids)))

    def _node(self, at: np.ndarray, rng: np.random.Generator):
        if len(at) <= LEAF:
            return np.sort(at)
        # of a few candidates the vantage point whose distances are spread most
        tried = rng.choice(at, min(8, len(at)), replace=False)
        probe = rng.choice(at, min(64, len(at)), replace=False)
        spread = [np.std(np.linalg.norm(self.units[probe] - self.units[t], axis=1)) for t in tried]
        vantage = int(tried[int(np.argmax(spread))])
        d = np.linalg.norm(self.units[at] - self.units[vantage], axis=1)
        radius = float(np.median(d))
        near = d <= radius
        if near.all():  # all at one distance: no split possible
            return np.sort(at)
        return vantage, radius, self._node(at[near], rng), self._node(at[~near], rng)

    def search(self, ids: np.ndarray, vecs: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest of each query other than itself, ties to the smaller id; -1 where there are fewer."""
        self.q, self.asked_vecs, self.own = unit(vecs), vecs, ids
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), -1)
        self._visit(self.root, np.arange(len(ids)), factor)
        return self.who, self.best

    def _leaf(self, node: np.ndarray, asked: np.ndarray) -> None:
        """Rank what may be among the k best by the final measure, so that equal distances never hide a better one."""
        k = self.best.shape[1]
        dots = self.q[asked] @ self.units[node].T
        dots[self.own[asked][:, None] == self.ids[node]] = -np.inf
        least = self.best[asked, -1]
        if len(node) > k:
            least = np.maximum(least, -np.partition(-dots, k - 1, 1)[:, k - 1])
        row, col = np.nonzero((dots >= least[:, None] - SLACK) & (dots > -np.inf))
        if not len(row):
            return
        score = np.concatenate([cosines(self.asked_vecs[asked[row[a : a + BLOCK]]], self.vecs[node[col[a : a + BLOCK]]]) for a in range(0, len(row), BLOCK)])
        hit = np.unique(row)
        old_row, old_col = np.nonzero(self.who[asked[hit]] >= 0)
        row = np.concatenate([row, hit[old_row]])
        who = np.concatenate([node[col], self.who[asked[hit]][old_row, old_col]])
        score = np.concatenate([score, self.best[asked[hit]][old_row, old_col]])
        order = np.lexsort((who, -score, row))  # rows of the tree are in the order of ids
        row, who, score = row[order], who[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.best[asked[row[keep]], place[keep]] = score[keep]
        self.who[asked[row[keep]], place[keep]] = who[keep]

    def _visit(self, node, asked: np.ndarray, factor: float) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, asked)
        vantage, radius, near, far = node
        d = np.linalg.norm(self.q[asked] - self.units[vantage], axis=1)
        inside = d <= radius
        self._visit(near, asked[inside], factor)
        self._visit(far, asked[~inside], factor)
        # strictly beyond, with room for rounding: equal distances may still win by a smaller id
        worst = np.sqrt(np.maximum(0, 2 - 2 * self.best[asked, -1])) + 1e-7
        open_ = np.abs(d - radius) * factor <= worst
        self._visit(far, asked[inside & open_], factor)
        self._visit(near, asked[~inside & open_], factor)


def _answer(batches: Batches, k: int, factor: float) -> Batches:
    """Rows (task, dim, asks, id, vec): gather the vectors held in a task, build their tree, then answer its queries in blocks."""
    place, tree, held = None, None, []
    for (task, dim, asks), rows in runs(batches, 3):
        if (task, dim) != place:
            place, tree, held = (task, dim), None, []
        ids, vecs = rows.column(3).to_numpy(), matrix(rows.column(4))
        if not asks:
            held.append((ids, vecs))
            continue
        if held:
            tree, held = VPTree(*(np.concatenate([h[i] for h in held]) for i in (0, 1))), []
        if tree is None:  # no vector of this length here
            continue
        for a in range(0, len(ids), 512):
            who, score = tree.search(ids[a : a + 512], vecs[a : a + 512], k, factor)
            q, j = np.nonzero(who >= 0)
            yield pa.RecordBatch.from_pydict({"query_id": ids[a : a + 512][q], "vec_id": tree.ids[who[q, j]], "score": score[q, j]})


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0, shard_rows: int = 50_000, least_shards: int = 6, block_queries: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries`` by cosine.

    Returns (query_id, rank from 1, vec_id, score), ties to the smaller id (also between vectors
    of one direction and other lengths, whose cosines may differ in the last bit), at most one row
    fewer than there are vectors. A row with the query's own id is no candidate. Vectors that
    have no direction (see ``usable_vectors``) take no part; of rows that repeat an id one
    counts; only vectors of one length are compared. Without vectors or queries the result is
    empty. ``factor`` 1 is exact; above one it trades recall for speed. A task holds one shard and one
    block of queries; each shard's tree is built for each block.
    """
    if factor < 1:
        raise ValueError("factor must be 1 (exact) or more")
    held = usable_vectors(vectors, id_col, vector_col)
    asked = usable_vectors(queries, id_col, vector_col)
    shards = shard_count(vectors.count(), shard_rows, least_shards)
    blocks = shard_count(queries.count(), block_queries, 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = held.select(shard_of(shards).alias("shard"), each(blocks).alias("block"), F.lit(0).alias("asks"), "id", "vec")
    every = asked.select(each(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("asks"), "id", "vec")
    rows = own.unionByName(every).select((F.col("shard") * blocks + F.col("block")).alias("task"), F.size("vec").alias("dim"), "asks", "id", "vec")
    found = by_task(rows, shards * blocks, "task", "dim", "asks", "id").mapInArrow(partial(_answer, k=k, factor=factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
