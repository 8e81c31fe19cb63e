"""Dealing vectors and queries to shards, for the searches over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vec array<double>) of the vectors that have a direction.

    Rows without an id and vectors that are null, empty or zero, or hold null, NaN or infinite
    components are left out. Of rows that repeat an id the least vector (in array order) counts.
    """
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = "size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)"
    return out.where("id is not null and vec is not null").where(F.coalesce(F.expr(finite), F.lit(False))).groupBy("id").agg(F.min("vec").alias("vec"))


def shard_count(rows: int, shard_rows: int, least: int) -> int:
    return max(least, -(-rows // shard_rows))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def by_task(df: DataFrame, tasks: int, *order: str) -> DataFrame:
    """``df`` with each value of ``task`` (0 .. tasks-1) in a partition of its own, sorted by ``order`` in it."""
    return df.repartitionById(tasks, F.col("task")).sortWithinPartitions(*order)


def runs(batches: Batches, keys: int) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Cut sorted batches at each change of their first ``keys`` (integer) columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(key[a].tolist()), batch.slice(a, b - a)


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length, a row for each."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def unit(vecs: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (first by their largest part, so that nothing overflows)."""
    vecs = vecs / np.abs(vecs).max(1, keepdims=True)
    return vecs / np.sqrt((vecs * vecs).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, products added from first to last as SQL list functions do."""
    a, b = (x / np.abs(x).max(1, keepdims=True) if not 1e-100 < np.abs(x).max(initial=1) < 1e100 else x for x in (a, b))
    dot, aa, bb = (np.cumsum(x, 1)[:, -1] for x in (a * b, a * a, b * b))
    return dot / (np.sqrt(aa) * np.sqrt(bb))
