"""Near-duplicate vectors with small-world graphs (operator 3).

Equal vectors are one class. The classes are dealt to shards; each shard is a hierarchical
navigable small-world graph, built once and written to the shared folder. Every class asks every
shard: each pair of shards is one task, which searches either graph for the other's vectors.
A beam whose members all lie within the threshold is doubled until some do not; a vector with so
many neighbours that its beam outgrows a limit is compared with the whole shard instead. Each
direction of a task audits itself: the known answers of a sample of the asking vectors, found by
comparing them with the whole shard, must come back, vector by vector on average, or its beams are
doubled. What the beams hold is verified by cosine in double precision; a link counts for both
its ends, whichever found it. Only counts and edges that span the components leave a task.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, dropped, mix, written
from gradeflow.llm.components import connected_components, forest
from gradeflow.llm.vectors import by_task, cosines, matrix, runs, shard_count, shard_of, unit, usable_vectors

STEP = 4  # beam members opened at once


class HNSW:
    """A layered proximity graph. Levels come from the ids, so a rebuilt shard is the same."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, copies: np.ndarray | None = None, links: int = 12, beam: int = 48, block: int = 256) -> None:
        order = np.argsort(mix(ids.view(np.uint64), 11))  # insertion order
        self.ids, self.vecs = ids[order], vecs[order]
        self.copies = copies[order] if copies is not None else np.ones(len(ids), np.int64)
        self.units = unit(self.vecs).astype(np.float32)
        self.links, n = links, len(ids)
        draw = (mix(self.ids.view(np.uint64), 12) >> np.uint64(11)).astype(float) / 2**53
        self.level = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(links)).astype(int)
        self.level[0] = max(self.level.max(initial=0), self.level[0]) if n else 0
        self.graphs = [np.full((n, links * (2 if lv == 0 else 1)), -1) for lv in range(int(self.level[0]) + 1 if n else 0)]
        for start in range(1, n, block):
            self._insert(np.arange(start, min(n, start + block)), beam)

    def _insert(self, new: np.ndarray, beam: int) -> None:
        q = self.units[new]
        entry = np.zeros((len(new), 1), int)
        for level in range(len(self.graphs) - 1, -1, -1):
            found, d = self._beam(q, entry, level, beam)
            here = self.level[new] >= level
            if here.any():
                own, among = new[here], self.units[new[here]]
                # the block's members are not in the graph yet: compare them with each other
                near = 1 - among @ among.T
                np.fill_diagonal(near, np.inf)
                order = np.argsort(near, 1)[:, :beam]
                cand = np.concatenate([found[here], own[order]], 1)
                dist = np.concatenate([d[here], np.take_along_axis(near, order, 1)], 1)
                dist[dist == np.inf] = 9
                self._connect(own, cand, dist, level)
            entry = np.where(found[:, : max(1, beam // 8)] >= 0, found[:, : max(1, beam // 8)], 0)

    def _pick(self, cand: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
        """Up to m neighbours of each row: nearest first, those nearer to a chosen one only to fill up."""
        order = np.argsort(dist, 1, kind="stable")[:, : 4 * m]
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        ok = (cand >= 0) & (dist < 9)
        vec = self.units[np.maximum(cand, 0)]
        mutual = 1 - np.einsum("bid,bjd->bij", vec, vec)
        chosen = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            blocked = (chosen & (mutual[:, j, :] < dist[:, j, None])).any(1)
            chosen[:, j] = ok[:, j] & ~blocked & (chosen.sum(1) < m)
        rank = np.where(chosen, 0, np.where(ok, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        # half the places at most go to what only fills up
        fill = np.argsort(rank, 1)[:, :m]
        out = np.take_along_axis(cand, fill, 1)
        return np.where(np.take_along_axis(ok, fill, 1), out, -1)

    def _connect(self, own: np.ndarray, cand: np.ndarray, dist: np.ndarray, level: int) -> None:
        graph = self.graphs[level]
        picked = self._pick(cand, dist, self.links)
        graph[own, : picked.shape[1]] = picked
        # and back: the neighbours take the new ones in, and choose again where that is too many
        src = np.repeat(own, picked.shape[1])
        dst = picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads = np.flatnonzero(np.diff(dst, prepend=-1))
        counts = np.diff(np.append(heads, len(dst)))
        nodes = dst[heads]
        width = graph.shape[1]
        more = np.full((len(nodes), int(counts.max(initial=0))), -1)
        more[np.repeat(np.arange(len(nodes)), counts), np.arange(len(dst)) - np.repeat(heads, counts)] = src
        both = np.concatenate([graph[nodes], more], 1)
        both = -np.sort(-both, 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        few = (both >= 0).sum(1) <= width
        both = -np.sort(-both, 1)
        graph[nodes[few]] = np.pad(both[few], ((0, 0), (0, max(0, width - both.shape[1]))), constant_values=-1)[:, :width]
        many = np.flatnonzero(~few)
        if len(many):
            c = both[many]
            d = np.where(c >= 0, 1 - np.einsum("bd,bkd->bk", self.units[nodes[many]], self.units[np.maximum(c, 0)]), 9)
            chosen = self._pick(c, d, width)
            graph[nodes[many]] = np.pad(chosen, ((0, 0), (0, width - chosen.shape[1])), constant_values=-1)

    def _beam(self, q: np.ndarray, entry: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest that a search from ``entry`` meets; -1 and 9 where there are fewer."""
        graph = self.graphs[level]
        visited = np.zeros((len(q), len(self.ids)), bool)
        who, d = self._first(q, entry, visited)
        who = np.pad(who, ((0, 0), (0, max(0, beam - who.shape[1]))), constant_values=-1)[:, :beam]
        d = np.pad(d, ((0, 0), (0, max(0, beam - d.shape[1]))), constant_values=9)[:, :beam]
        opened = who < 0
        live = np.arange(len(q))
        while len(live):
            waiting = np.where(opened[live], 9, d[live])
            step = min(STEP, beam)
            pick = np.argpartition(waiting, step - 1, 1)[:, :step]
            todo = np.take_along_axis(waiting, pick, 1) < 9
            keep = todo.any(1)
            live, pick, todo = live[keep], pick[keep], todo[keep]
            if not len(live):
                break
            nodes = np.where(todo, who[live[:, None], pick], -1)
            opened[live[:, None], pick] = True
            near = graph[np.maximum(nodes, 0)]
            near[nodes < 0] = -1
            near = -np.sort(-near.reshape(len(live), -1), 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[visited[live[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            visited[live[r], near[r, c]] = True
            near = -np.sort(-near, 1)
            near = near[:, : max(1, int((near >= 0).sum(1).max()))]
            dist = np.where(near >= 0, 1 - np.einsum("bd,bkd->bk", q[live], self.units[np.maximum(near, 0)]), 9)
            all_who, all_d = np.concatenate([who[live], near], 1), np.concatenate([d[live], dist], 1)
            done = np.concatenate([opened[live], near < 0], 1)
            top = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            who[live], d[live], opened[live] = (np.take_along_axis(x, top, 1) for x in (all_who, all_d, done))
        order = np.argsort(d, 1, kind="stable")
        return np.take_along_axis(who, order, 1), np.take_along_axis(d, order, 1)

    def _first(self, q: np.ndarray, entry: np.ndarray, visited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = -np.sort(-entry, 1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        r, c = np.nonzero(entry >= 0)
        visited[r, entry[r, c]] = True
        return entry, np.where(entry >= 0, 1 - np.einsum("bd,bkd->bk", q, self.units[np.maximum(entry, 0)]), 9).astype(np.float32)

    def packed(self) -> bytes:
        """The graph as bytes; vectors that single precision holds exactly are kept in it."""
        short = self.vecs.astype(np.float32)
        vecs = short if (short == self.vecs).all() else self.vecs
        return pickle.dumps((self.ids, vecs, self.copies, self.links, self.level, [g.astype(np.int32) for g in self.graphs]))

    @classmethod
    def unpacked(cls, raw: bytes) -> HNSW:
        out = cls.__new__(cls)
        out.ids, vecs, out.copies, out.links, out.level, graphs = pickle.loads(raw)
        out.vecs, out.graphs = vecs.astype(np.float64), [g.astype(np.int64) for g in graphs]
        out.units = unit(out.vecs).astype(np.float32)
        return out

    def within(self, vecs: np.ndarray, threshold: float, beam: int, widest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, node) pairs with a cosine of ``threshold`` or more, and the rows whose beam would outgrow ``widest``.

        Beams widen until they hold others too.
        """
        q = unit(vecs).astype(np.float32)
        n, entry = len(self.ids), np.zeros((len(q), 1), int)
        for level in range(len(self.graphs) - 1, 0, -1):
            entry, _ = self._beam(q, entry, level, 4)
            entry = np.where(entry >= 0, entry, entry[:, :1])
        out_q, out_n, live, crowded = [], [], np.arange(len(q)), np.zeros(0, int)
        while len(live):
            width = min(beam, n)
            who, d = self._beam(q[live], entry[live], 0, width)
            full = (d[:, -1] <= 1 - threshold + 1e-5) & (width < n)
            a, b = np.nonzero((d <= 1 - threshold + 1e-5) & (who >= 0) & ~full[:, None])
            out_q.append(live[a])
            out_n.append(who[a, b])
            live, beam = live[full], 2 * beam
            if widest and beam > widest:
                crowded, live = live, live[:0]
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (out_q, out_n))
        sure = cosines(vecs[a], self.vecs[b]) >= threshold if len(a) else np.zeros(0, bool)
        return a[sure], b[sure], crowded

    def linked(self, vecs: np.ndarray, threshold: float) -> np.ndarray:
        """Which vectors of the whole graph lie within the threshold, by comparing with all: a row for each of ``vecs``."""
        if not hasattr(self, "exact"):
            self.exact = unit(self.vecs)
        dots = unit(vecs) @ self.exact.T
        out = dots >= threshold
        a, b = np.nonzero(np.abs(dots - threshold) < 1e-9)  # so near that the final measure decides
        if len(a):
            out[a, b] = cosines(vecs[a], self.vecs[b]) >= threshold
        return out


def _linked_sample(graph: HNSW, asks: HNSW, threshold: float, audit: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``audit`` asking vectors or more that have links, and these but for their own; all of eight samples where few have."""
    n = len(asks.ids)
    step = max(1, n // max(1, audit))
    rows, links = [], []
    for start in sorted({k * step // rounds for k in range(rounds)}):
        at = np.arange(start, n, step)
        dense = graph.linked(asks.vecs[at], threshold)
        if graph is asks:
            dense[np.arange(len(at)), at] = False
        some = dense.any(1)
        rows.append(at[some])
        links.append(dense[some])
        if sum(map(len, rows)) >= audit:
            break
    return np.concatenate(rows), np.concatenate(links)


class _Direction:
    """All searches of one graph for the vectors of another (or its own), with beams as wide as their audit asks for."""

    def __init__(self, graph: HNSW, asks: HNSW, threshold: float, beam: int, widest: int, audit: int, recall: float) -> None:
        sample, known = _linked_sample(graph, asks, threshold, audit)
        self.recall, self.sampled, self.beam = None, len(sample), beam
        while len(sample):
            a, b, crowded = graph.within(asks.vecs[sample], threshold, self.beam, widest)
            got = np.bincount(a, known[a, b], len(sample)) / known.sum(1)
            got[crowded] = 1  # these are compared with all
            # vector by vector, so that a crowd's many links don't outweigh those of the others
            self.recall = float(got.mean())
            if self.recall >= recall or self.beam >= min(widest, len(graph.ids)):
                break
            self.beam *= 2
        if self.recall is not None and self.recall < recall:  # wide beams did not do
            self.a, self.b, self.crowded = np.zeros(0, int), np.zeros(0, int), np.arange(len(asks.ids))
            return
        found, crowded = [], []
        for at in range(0, len(asks.ids), 256):
            a, b, c = graph.within(asks.vecs[at : at + 256], threshold, self.beam, widest)
            found.append((a + at, b))
            crowded.append(c + at)
        self.a, self.b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        self.crowded = np.concatenate(crowded)


class _Unions:
    """Labels of two graphs' nodes; equal labels are joined."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, nodes: np.ndarray) -> None:
        label = self.label[nodes]
        if (label != label[0]).any():
            held = np.unique(label)
            self.label[np.isin(self.label, held)] = held[0]


def links_between(left: HNSW, right: HNSW, threshold: float, beam: int = 32, widest: int = 512, audit: int = 64, recall: float = 0.999) -> tuple[np.ndarray, np.ndarray, list[_Direction]]:
    """Weighted links of the nodes of both graphs (of one, if they are the same) with each other, their labels, and the searches.

    A link counts for both ends if either search found it; vectors too crowded for a beam are
    compared with the whole other graph, in blocks.
    """
    same = left is right
    shift = 0 if same else len(left.ids)
    copies = left.copies if same else np.concatenate([left.copies, right.copies])
    counts, unions = np.zeros(len(copies), np.int64), _Unions(len(copies))
    ways = [_Direction(right, left, threshold, beam, widest, audit, recall)]
    pairs = [(ways[0].a, ways[0].b + shift)]
    if same:
        pairs.append(pairs[0][::-1])
    else:
        ways.append(_Direction(left, right, threshold, beam, widest, audit, recall))
        pairs.append((ways[1].b, ways[1].a + shift))
    crowded = np.zeros(len(copies), bool)
    crowded[ways[0].crowded] = True
    if not same:
        crowded[ways[1].crowded + shift] = True
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    keep = (a != b) & ~crowded[a] & ~crowded[b]
    if keep.any():
        a, b = np.unique(np.stack([a[keep], b[keep]], 1), axis=0).T
        counts += np.bincount(a, copies[b], len(copies)).astype(np.int64)
        if not same:
            counts += np.bincount(b, copies[a], len(copies)).astype(np.int64)
        nodes, roots = forest(a, b)
        unions.label[nodes] = roots
    for way, asks, graph, own, other in zip(ways, (left, right), (right, left), (0, shift), (shift, 0), strict=False):
        for at in range(0, len(way.crowded), 256):
            rows = way.crowded[at : at + 256]
            mask = graph.linked(asks.vecs[rows], threshold)
            if same:
                mask[np.arange(len(rows)), rows] = False
            counts[rows + own] += mask @ graph.copies
            calm = ~crowded[other : other + len(graph.ids)]
            counts[np.flatnonzero(calm) + other] += asks.copies[rows] @ mask[:, calm].astype(np.int64)
            for row, hits in zip(rows.tolist(), mask, strict=True):
                unions.join(np.append(np.flatnonzero(hits) + other, row + own))
    return counts, unions.label, ways


def _graphs(batches: Batches) -> Batches:
    """Rows (task, dim, id, copies, vec), a shard in each task -> (shard, dim, graph), one for each shard and length."""

    def built(place: tuple, parts: list) -> pa.RecordBatch:
        ids, copies, vecs = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.RecordBatch.from_pydict({"shard": pa.array([place[0]], pa.int32()), "dim": pa.array([place[1]], pa.int32()), "graph": pa.array([HNSW(ids, vecs, copies).packed()], pa.binary())})

    place, parts = None, []
    for key, rows in runs(batches, 2):
        if key != place:
            if parts:
                yield built(place, parts)
            place, parts = key, []
        parts.append((rows.column(2).to_numpy(), rows.column(3).to_numpy(), matrix(rows.column(4))))
    if parts:
        yield built(place, parts)


def _pairs(batches: Batches, threshold: float, beam: int, widest: int, audit: int, recall: float) -> Batches:
    """Rows (task, dim, low, high, shard, graph) -> (id, links, peer) of the classes, and the audits (shards, recall)."""

    def answer(low: int, high: int, held: list[HNSW]) -> pa.RecordBatch:
        left, right = held[0], held[-1]
        counts, label, ways = links_between(left, right, threshold, beam, widest, audit, recall)
        ids = left.ids if left is right else np.concatenate([left.ids, right.ids])
        some = np.flatnonzero((counts > 0) | (label != np.arange(len(label))))
        n, m = len(some), len(ways)
        null = lambda k, kind: pa.nulls(k, kind)
        return pa.RecordBatch.from_pydict({
            "id": pa.concat_arrays([pa.array(ids[some]), null(m, pa.int64())]), "links": pa.concat_arrays([pa.array(counts[some]), null(m, pa.int64())]), "peer": pa.concat_arrays([pa.array(ids[label[some]]), null(m, pa.int64())]),
            "graph_shard": pa.array([None] * n + [high, low][:m], pa.int32()), "asking_shard": pa.array([None] * n + [low, high][:m], pa.int32()), "sampled": pa.array([None] * n + [w.sampled for w in ways], pa.int64()), "beam": pa.array([None] * n + [w.beam for w in ways], pa.int64()), "recall": pa.array([None] * n + [w.recall for w in ways], pa.float64()),
        })

    place, held = None, []
    for (task, dim, low, high), rows in runs(batches, 4):
        if (task, dim) != place:
            place, held = (task, dim), []
        held += [HNSW.unpacked(g) for g in rows.column(5).to_pylist()]
        if len(held) == 1 + (low != high):
            yield answer(low, high, held)


_FOUND = "id long, links long, peer long, graph_shard int, asking_shard int, sampled long, beam long, recall double"


def near_vectors(vectors: DataFrame, **how) -> DataFrame:
    """Links and components of vectors with a cosine of ``threshold`` (0.95) or more; ``how`` as for ``audited_near_vectors``.

    Returns (id, n_links, component_id, kept), a row for each distinct id: the number of other
    vectors linked with it directly, the smallest id reachable, and whether that is its own.
    Vectors without a direction (see ``usable_vectors``) link with nothing; of rows that repeat
    an id one counts; rows without an id have no row. Vectors of different lengths never link.
    An empty table has no rows.
    """
    return audited_near_vectors(vectors, **how)[0]


def audited_near_vectors(vectors: DataFrame, *, threshold: float = 0.95, beam: int = 32, widest: int = 512, audit: int = 64, recall: float = 0.999, shard_rows: int = 50_000, least_shards: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The links of ``near_vectors``, and the audits: (graph_shard, asking_shard, sampled, beam, recall), a row for each search.

    ``recall`` there is the mean over the ``sampled`` asking vectors that have links, null where no sampled one has.
    """
    ids = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    good = usable_vectors(vectors, id_col, vector_col)
    classes = written(good.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "hnsw-classes")
    shards = shard_count(classes.count(), shard_rows, least_shards)
    rows = classes.select(F.col("rep").alias("id"), "copies", "vec").select(shard_of(shards).alias("task"), F.size("vec").alias("dim"), "id", "copies", "vec")
    graphs = written(by_task(rows, shards, "task", "dim", "id").mapInArrow(_graphs, "shard int, dim int, graph binary"), "hnsw-graphs")
    # a task for each pair of shards, one with itself too
    each = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumns({"low": F.least("shard", "other"), "high": F.greatest("shard", "other")})
    each = each.select(F.expr("cast(high * (high + 1) / 2 + low as int)").alias("task"), "dim", "low", "high", "shard", "graph")
    asked = by_task(each, shards * (shards + 1) // 2, "task", "dim", "shard").mapInArrow(partial(_pairs, threshold=threshold, beam=beam, widest=widest, audit=audit, recall=recall), _FOUND)
    found = written(asked, "hnsw-found")
    dropped(graphs)
    links = found.where("id is not null")
    joined = connected_components(links.select(F.col("id").alias("a"), F.col("peer").alias("b")), "hnsw-components")

    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select("rep", "copies").join(counted, F.col("rep") == counted.id, "left").drop("id").join(joined, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = good.join(classes.select("vec", "rep"), "vec").select("id", "rep")
    out = ids.join(member, "id", "left").join(of_class, "rep", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out, found.where("id is null").select("graph_shard", "asking_shard", "sampled", "beam", "recall")
