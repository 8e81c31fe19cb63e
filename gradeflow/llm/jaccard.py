"""N-gram Jaccard join with count vectors (operator 7).

Tokens (hashes of word shingles) are hashed into groups; a document is the point of its
group counts. The overlap of two sets is at most the sum over the groups of the smaller
count, and at most the sum of the smaller of a count and the upper corner of a box, so an
R-tree over the points rules out whole boxes. Pairs that survive are verified on the sets.

On a cluster no single tree can hold all points, and a box over many random points rules out
nothing. The points are therefore first dealt by an exact law. Sets of similar size are cut
into more groups than the largest symmetric difference that the threshold leaves room for;
then two linked sets agree on a group that neither has empty. The agreement on a group
(with a fingerprint of its members, finer than the count alone) is a cell; sets too small
for that share a cell for one of their first tokens in the order of hashes. Hardly a cell
has two members; those that do meet, once for each distinct set of members. Each meeting is
one tree over the points alone (or, if small, its pairs), which decides by the bounds who may
have a link there; copies of one text meet often, so each is first compared with the first and
last of its cells, and meetings of what that joins already are passed over. Passages that many
documents share make meetings of documents that have little more in common; these end
here, so they join nothing. Documents that may link are joined into families, whose texts are
fetched to verify the pairs. A large meeting or family is cut into bands of sizes and those
into blocks, and every pair of blocks is a tree. No link is lost and no candidate capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, dropped, mix, row_sums, shingle_sets, slices, utf8, written
from gradeflow.llm.components import connected_components

NODE = 16  # children of a tree node
LEAF = 512  # points of a leaf


def least_overlap(total: np.ndarray | int, num: int, den: int):
    """Smallest intersection with den * i >= num * (total - i), where total = |S| + |T|."""
    return -(-num * total // (num + den))


ONE_BY_ONE = -1


class Law(NamedTuple):
    """How sets are dealt to cells; every law keeps every link."""

    wide: int  # percent by which a size class grows, from 128 tokens on; smaller ones grow by 10
    few: int  # a group of fewer tokens makes no cell, if the sizes allow it


LAW = Law(50, 2)
TINY = 12  # size classes that begin below are too small to be cut into groups


def schemes(largest: int, num: int, den: int, law: Law = LAW) -> list[tuple[int, int, int, int, int, int]]:
    """(first size, end of the own sizes, largest size met, groups, room, few) of each size class.

    A size class holds sets of the sizes first .. end-1, and as visitors the larger sets
    that may still link with one of them. ``room`` is the largest symmetric difference of a
    linked pair there, so two linked sets agree on groups - room groups at least; there are
    so many groups that hardly a set has as many with fewer than ``few`` tokens. Tiny sets
    (``ONE_BY_ONE``) agree on one of their first tokens instead. 0 groups: only equal sets link.
    """
    out, first = [], 1
    while first <= largest:
        end = max(first + 1, first * (100 + (law.wide if first >= 128 else 10)) // 100)
        met = (end - 1) * den // num
        room = ((end - 1 + met) * (den - num)) // (num + den)
        for few in range(law.few, 0, -1):
            groups = room + 3
            for _ in range(8):
                mean = first / groups
                poor = groups * np.exp(-mean) * sum(mean**k / factorial(k) for k in range(few))
                groups = room + 2 + int(np.ceil(poor + 2.5 * np.sqrt(poor)))
            if groups <= 1.35 * room + 4:
                break
        out.append((first, end, met, 0 if not room else ONE_BY_ONE if first < TINY else min(groups, 2 * room + 8), room, few))
        first = end
    return out


def cells(s: np.ndarray, v: np.ndarray, at: np.ndarray, k: np.ndarray, plan: list[tuple], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of many sets and the offsets of each set's.

    ``s`` holds sorted hashes, ``v`` their mixed values, ``at`` the sets' offsets, ``k`` the
    size class in which each set is asked for (-1: none).
    """
    size = np.diff(at)
    groups, room, few = (np.append([p[i] for p in plan], 0)[k] for i in (3, 4, 5))
    salt = k.astype(np.uint64) << np.uint64(32)
    values, owners = [], []

    # linked sets of these sizes share one of the first size - least overlap + 1 tokens
    tiny = np.flatnonzero((groups == ONE_BY_ONE) & (size > 0))
    heads = size[tiny] - -(-num * size[tiny] // den) + 1
    owner = np.repeat(tiny, heads)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(heads) - heads, heads)
    values.append(mix(s[at[owner] + place] + salt[owner], 9))
    owners.append(owner)

    groups = np.where(size > 0, np.maximum(groups, 0), 0)
    live = np.repeat(groups > 0, size)
    owner = np.repeat(np.arange(len(k)), size)[live]
    if len(owner):
        # the hashes are sorted, so the groups (equal ranges of hashes) are runs
        group = ((s[live] >> np.uint64(32)) * groups.astype(np.uint64)[owner]) >> np.uint64(32)
        head = np.ones(len(owner), bool)
        head[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(head)
        sums, filled, whose = np.add.reduceat(v[live], starts), group[starts], owner[starts]
        poor = np.diff(np.append(starts, len(owner))) < few[whose]
        short = (groups - np.bincount(whose[~poor], minlength=len(k)) >= groups - room) & (groups > 0)
        keep = ~poor | short[whose]
        values.append(mix(sums + mix(filled + salt[whose], 4), 5)[keep])
        owners.append(whose[keep])
        for i in np.flatnonzero(short).tolist():
            # so many groups of few tokens that a linked pair may agree on these alone, even on empty ones
            none = np.setdiff1d(np.arange(groups[i], dtype=np.uint64), filled[whose == i])
            values.append(mix(none + salt[i], 6))
            owners.append(np.full(len(none), i))
    whose = np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(values)[order], np.searchsorted(whose[order], np.arange(len(k) + 1))


def _fingerprints(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mixed values and two 64-bit fingerprints of each set."""
    v = mix(s, 7)
    return v, row_sums(v, at).view(np.int64), row_sums(v * v ^ (v >> np.uint64(29)), at).view(np.int64)


def _dealt(s: np.ndarray, v: np.ndarray, at: np.ndarray, num: int, den: int, law: Law, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of sets and whose they are: of each set in its own size class and as a visitor of those below it."""
    n = np.diff(at)
    plan = schemes(2 * int(n.max(initial=0)) + 64, num, den, law)
    ends, met = (np.array([p[i] for p in plan]) for i in (1, 2))
    own = np.searchsorted(ends, n, side="right")
    own[skip] = -1
    values, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while (own >= 0).any():
        found, bounds = cells(s, v, at, own, plan, num, den)
        values.append(found)
        whose.append(np.repeat(np.arange(len(n)), np.diff(bounds)))
        own = np.where((own > 0) & (n <= met[own - 1]), own - 1, -1)
    return np.concatenate(values), np.concatenate(whose)


def points(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The group counts of each set as 16-bit numbers: 128 groups, 512 from 1024 tokens on, twice as many while a count would not fit.

    Groups are the low bits of the tokens' hashes, so a longer point folds into a shorter one.
    """
    n = np.diff(at)
    wide = n >= 1024
    out = []
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        size = 512 if wide[k] else 128
        while (count := np.bincount((s[a:b] & np.uint64(size - 1)).astype(np.int64), minlength=size)).max() > 65535:
            size *= 2
        out.append(count.astype("<u2").tobytes())
    return out


def folded(raw: list[bytes]) -> np.ndarray:
    """Points of one length, a row for each: longer ones have their groups added up."""
    size = min(map(len, raw), default=2) // 2
    # counts are added in 32 bits: a point may only ever promise too much
    return np.stack([np.frombuffer(r, "<u2").astype(np.int32).reshape(-1, size).sum(0) for r in raw])


def _signed(batches: Batches, words: int) -> Batches:
    """Rows (doc_id, text, h) -> the size, two fingerprints and the point of each set."""
    for batch in slices(batches, "text"):
        s, at = shingle_sets(*utf8(batch.column(1)), words)
        _, one, two = _fingerprints(s, at)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "h": batch.column(2), "n": pa.array(np.diff(at).astype(np.int64)), "fp": pa.array(one), "fp2": pa.array(two), "point": pa.array(points(s, at), pa.binary())})


def _keyed(batches: Batches, words: int, num: int, den: int) -> Batches:
    """Rows with a text -> (cell, fp), a row for each cell of each set; a copy met before in the task adds none."""
    seen: set[int] = set()
    for batch in slices(batches, "text"):
        s, at = shingle_sets(*utf8(batch.column(batch.schema.get_field_index("text"))), words)
        v, one, _ = _fingerprints(s, at)
        if len(seen) > 1_000_000:
            seen.clear()
        known = np.zeros(len(one), bool)
        for i, f in enumerate(one.tolist()):
            known[i] = f in seen
            seen.add(f)
        cell, whose = _dealt(s, v, at, num, den, LAW, known)
        yield pa.RecordBatch.from_pydict({"cell": cell.view(np.int64), "fp": one[whose]})


def _meetings(batches: Batches) -> Batches:
    """Rows (cell, fp) sorted by cell -> (meeting, fp, first, last) of the cells with several members; a set of members met before in the task adds none.

    A meeting is named by a hash of its members, so equal sets of members are one meeting.
    """
    seen: set[int] = set()

    def met(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        more = np.flatnonzero(cell[1:] == cell[:-1])
        rows = np.union1d(more, more + 1)
        cell, fp = cell[rows], fp[rows]
        order = np.lexsort((fp, cell))
        cell, fp = cell[order], fp[order]
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])
        cell, fp = cell[fresh], fp[fresh]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(cell))
        name = row_sums(mix(fp.view(np.uint64), 11), np.append(starts, len(cell))).view(np.int64)
        new = np.zeros(len(starts), bool)
        once = np.unique(name, return_index=True)[1]
        once = once[(ends - starts)[once] > 1]
        new[once] = [x not in seen for x in name[once].tolist()]
        if len(seen) > 1_000_000:
            seen.clear()
        seen.update(name[new].tolist())
        count = (ends - starts)[new]
        keep = np.repeat(new, ends - starts)
        return pa.RecordBatch.from_pydict({"meeting": np.repeat(name[new], count), "fp": fp[keep], "first": np.repeat(fp[starts[new]], count), "last": np.repeat(fp[ends[new] - 1], count)})

    parts: list[tuple[np.ndarray, np.ndarray]] = []  # the last cell, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not parts or cell[0] != cell[-1] or cell[0] != parts[-1][0][0]:
            held = int(np.searchsorted(cell, cell[-1]))
            done = [*parts, (cell[:held], fp[:held])]
            yield met(*(np.concatenate(x) for x in zip(*done, strict=True)))
            parts = []
            cell, fp = cell[held:], fp[held:]
        parts.append((cell, fp))
    if parts:
        yield met(*(np.concatenate(x) for x in zip(*parts, strict=True)))


class CountTree:
    """An R-tree over group counts, packed by size and counts, built level by level.

    Leaves hold their points column by column, so that a sum over groups runs along memory.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort([points[:, np.argmax(points.var(0))], sizes]) if len(points) else np.zeros(0, int)
        kind = np.uint16 if sizes.max(initial=0) < 65536 else np.int64  # sums of minima never exceed a size
        self.order, self.sizes = order, sizes[order]
        cut = np.arange(0, len(order), LEAF)
        sorted_points = points[order].astype(kind)
        self.leaves = [np.ascontiguousarray(sorted_points[a : a + LEAF].T) for a in cut.tolist()]
        hi, lo_n, hi_n = sorted_points, self.sizes, self.sizes
        self.levels = []
        while len(cut):
            hi, lo_n, hi_n = np.maximum.reduceat(hi, cut, axis=0), np.minimum.reduceat(lo_n, cut), np.maximum.reduceat(hi_n, cut)
            self.levels.append((hi, lo_n, hi_n))
            if len(cut) == 1:
                break
            cut = np.arange(0, len(hi), NODE)

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Rows whose bound leaves room for a link with a set of ``size`` tokens at ``point``."""
        if not self.levels:
            return self.order
        point = np.minimum(point, 65535).astype(self.leaves[0].dtype) if self.leaves[0].dtype == np.uint16 else point
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = self.levels[level]
            at = at[(lo_n[at] * num <= size * den) & (hi_n[at] * den >= size * num)]
            bound = np.minimum(hi[at], point).sum(1, dtype=np.int64)
            at = at[np.minimum(bound, size) >= least_overlap(size + np.maximum(lo_n[at], -(-size * num // den)), num, den)]
            if level:
                at = (at[:, None] * NODE + np.arange(NODE)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        column, found = point[:, None], []
        for k in at.tolist():
            held = self.sizes[k * LEAF : (k + 1) * LEAF]
            bound = np.add.reduce(np.minimum(self.leaves[k], column), axis=0, dtype=column.dtype)
            found.append(np.flatnonzero((bound >= least_overlap(size + held, num, den)) & (held * num <= size * den) & (held * den >= size * num)) + k * LEAF)
        return self.order[np.concatenate(found)] if found else self.order[:0]


def candidates(tree: CountTree, held: np.ndarray, asked: np.ndarray, pts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking row with the held rows whose bounds leave room for a link; a row is none of its own."""
    for i in asked.tolist():
        found = held[tree.search(pts[i], int(sizes[i]), num, den)]
        found = found[found != i]
        if len(found):
            yield i, found


def _sides(side: np.ndarray, pts: np.ndarray, sizes: np.ndarray) -> tuple[CountTree, np.ndarray, np.ndarray]:
    """The tree over one side of a block pair (or over all of one block), its rows, and the rows that ask."""
    two = side.any() and not side.all()
    held = np.flatnonzero(side == 1) if two else np.arange(len(side))
    return CountTree(pts[held], sizes[held]), held, np.flatnonzero(side == 0) if two else held


def link_forest(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Join the linked sets of two sides (or of one); (i, j) pairs that span the components.

    Pairs that are joined already are passed over: only components are asked for.
    """
    sizes = np.array([len(s) for s in sets])
    groups = int(np.clip(1 << int(np.median(sizes)).bit_length(), 16, 1024))
    pts = np.stack([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)
    root, out = list(range(len(sets))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, found in candidates(*_sides(side, pts, sizes), pts, sizes, num, den):
        for j in found.tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * same >= num * (sizes[i] + sizes[j] - same):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    pairs = np.array(out, int).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _blocks(batches: Batches) -> Iterator[pa.Table]:
    """The rows of each block in turn, from rows sorted by block (the first column)."""
    parts, block = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if key[a] != block:
                if parts:
                    yield pa.Table.from_batches(parts)
                parts, block = [], key[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def near(raw: list[bytes], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bounds of the rows ``i`` and ``j`` leave room for a link, pair by pair."""
    lengths = np.array([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
    least = least_overlap(sizes[i] + sizes[j], num, den)
    out = np.minimum(sizes[i], sizes[j]) >= least
    short = np.minimum(lengths[i], lengths[j])
    for length in np.unique(short[out]).tolist():
        at = np.flatnonzero(out & (short == length))
        rows, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        pts = np.empty((len(rows), length // 2), np.int32)
        for k in np.unique(lengths[rows]).tolist():
            of = np.flatnonzero(lengths[rows] == k)
            pts[of] = np.frombuffer(b"".join(raw[r] for r in rows[of].tolist()), "<u2").reshape(len(of), -1, length // 2).sum(1, dtype=np.int32)
        one, two = place[: len(at)], place[len(at) :]
        step = max(1, (1 << 21) // (length // 2))  # so many numbers at a time
        for a in range(0, len(at), step):
            bound = np.minimum(pts[one[a : a + step]], pts[two[a : a + step]]).sum(1, dtype=np.int64)
            out[at[a : a + step]] = bound >= least[at[a : a + step]]
    return out


def _near_pairs(batches: Batches, num: int, den: int) -> Batches:
    """Rows (a, b, n, point, n_b, point_b) -> the pairs (a, b) whose bounds leave room for a link."""
    for batch in batches:
        k = batch.num_rows
        sizes = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()])
        keep = near(batch.column(3).to_pylist() + batch.column(5).to_pylist(), sizes, np.arange(k), np.arange(k, 2 * k), num, den)
        yield batch.select([0, 1]).filter(pa.array(keep))


SMALL = 64  # rows of a meeting whose pairs are compared without a tree


def _small_pairs(rows: pa.Table, block: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of one block (rows sorted by it), of other roots and of sides that meet, whose bounds leave room for a link."""
    fp, root, side = rows.column(1).to_numpy(), rows.column(5).to_numpy(), rows.column(2).to_numpy()
    two = np.isin(block, np.intersect1d(block[side == 0], block[side == 1]))
    pairs = []
    for gap in range(1, SMALL):
        i = np.flatnonzero(block[gap:] == block[:-gap])
        if not len(i):
            break
        j = i + gap
        keep = (root[i] != root[j]) & (fp[i] != fp[j]) & (~two[i] | (side[i] != side[j]))
        pairs.append(np.stack([i[keep], j[keep]]))
    i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    if len(i):  # what met in several blocks is compared once
        one, two = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
        order = np.lexsort((two, one))
        fresh = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
        i, j = i[order[fresh]], j[order[fresh]]
        keep = near(rows.column(4).to_pylist(), rows.column(3).to_numpy(), i, j, num, den)
        i, j = i[keep], j[keep]
    return fp[i], fp[j]


def _tree_pairs(rows: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the rows of one large block as far as the tree's bounds leave room for links, but for what has one root already."""
    pts, sizes, side = folded(rows.column(4).to_pylist()), rows.column(3).to_numpy(), rows.column(2).to_numpy()
    fp, root = rows.column(1).to_numpy(), np.unique(rows.column(5).to_numpy(), return_inverse=True)[1]
    out = []
    for i, found in candidates(*_sides(side, pts, sizes), pts, sizes, num, den):
        other, at = np.unique(root[found], return_index=True)
        for r, j in zip(other.tolist(), found[at].tolist(), strict=True):
            if r != root[i]:
                out.append((fp[i], fp[j]))
                root[root == r] = root[i]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _met(batches: Batches, num: int, den: int) -> Batches:
    """Rows (block, fp, side, n, point, root) sorted by block -> pairs (a, b) that join all those of other roots that may link there."""
    few: list[pa.Table] = []

    def pairs(tables: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(tables).combine_chunks()
        a, b = _small_pairs(rows, np.repeat(np.arange(len(tables)), [t.num_rows for t in tables]), num, den)
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    held = 0
    for rows in _blocks(batches):
        if rows.num_rows > SMALL:
            a, b = _tree_pairs(rows, num, den)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})
        elif rows.num_rows > 1:
            few.append(rows)
            held += rows.num_rows
            if held > 8192:
                yield pairs(few)
                few, held = [], 0
    if few:
        yield pairs(few)


def _families(batches: Batches, words: int, num: int, den: int) -> Batches:
    """Rows (block, fp, side, text) sorted by block -> edges between linked sets."""

    def done(fps: list, sets: list, sides: list) -> pa.RecordBatch:
        a, b = link_forest(sets, np.array(sides), num, den)
        fp = np.array(fps, np.int64)
        return pa.RecordBatch.from_pydict({"a": fp[a], "b": fp[b]})

    block, fps, sets, sides = None, [], [], []
    for batch in slices(batches, "text"):
        tokens, at = shingle_sets(*utf8(batch.column(3)), words)
        _, got, _ = _fingerprints(tokens, at)
        own = np.split(tokens, at[1:-1])
        for k, fp, side, s, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, got.tolist(), strict=True):
            if k != block:
                if len(sets) > 1:
                    yield done(fps, sets, sides)
                block, fps, sets, sides = k, [], [], []
            if g == fp:  # another text under the same id is no member
                fps.append(fp)
                sets.append(s)
                sides.append(side)
    if len(sets) > 1:
        yield done(fps, sets, sides)


def _placed(members: DataFrame, num: int, den: int, leaf_rows: int, leaf_tokens: int) -> DataFrame:
    """Rows (family, fp, n, ...) -> (block, fp, side, n, ...): each two members that may link by their sizes share a block.

    A family of more than ``leaf_rows`` is cut by size and into parts, and every pair of parts is a block.
    """
    more = [c for c in members.columns if c not in ("family", "fp", "n")]
    large = members.groupBy("family").agg((F.count("*") > leaf_rows).alias("large")).where("large")
    # linked sets are of one band or of neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / (float(np.log(den / num)) * (1 + 1e-9))).cast("int")
    placed = members.join(large, "family", "left").withColumn("band", F.explode(F.when(F.col("large"), F.array(band, band - 1)).otherwise(F.array(F.lit(-1))))).drop("large")
    held = placed.where("band >= 0").groupBy("family", "band").agg(F.count("*").alias("held"), F.sum("n").alias("tokens"))
    blocks = F.least("held", F.ceil(F.greatest(F.col("tokens") / F.lit(leaf_tokens), F.col("held") / F.lit(leaf_rows)))).cast("int")
    held = held.select("family", "band", "held", blocks.alias("blocks"))
    placed = placed.join(held, ["family", "band"], "left").where("held is null or held > 1").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # every pair of blocks meets once; one block alone is a pair with itself
    placed = placed.withColumn("pair", F.explode(F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, own) as i, greatest(k, own) as j))")))
    side = F.when(F.col("pair.i") == F.col("pair.j"), 0).otherwise((F.col("own") == F.col("pair.j")).cast("int"))
    return placed.select(F.xxhash64("family", "band", "pair.i", "pair.j").alias("block"), "fp", side.alias("side"), "n", *more)


def _may_link(texts: DataFrame, classes: DataFrame, words: int, num: int, den: int, leaf_rows: int, leaf_tokens: int) -> DataFrame:
    """(node, component) of the fingerprints of texts that are joined by pairs whose bounds leave room for a link.

    Cells pass one shuffle and are never stored; what meets in them is.
    """
    cells_ = texts.mapInArrow(partial(_keyed, words=words, num=num, den=den), "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    meetings = written(cells_.mapInArrow(_meetings, "meeting long, fp long, first long, last long").distinct(), "jaccard-meetings")
    points_ = classes.select("fp", "n", "point")

    stars = meetings.select("fp", F.explode(F.array("first", "last")).alias("b")).where("fp <> b").distinct()
    stars = stars.join(points_, "fp").select(F.col("fp").alias("a"), F.col("b").alias("fp"), F.col("n").alias("n_a"), F.col("point").alias("point_a")).join(points_, "fp")
    close = written(stars.select("a", F.col("fp").alias("b"), "n_a", "point_a", "n", "point").mapInArrow(partial(_near_pairs, num=num, den=den), "a long, b long"), "jaccard-close")
    joined = connected_components(close, "jaccard-close-joined")

    rooted = meetings.join(joined, F.col("fp") == F.col("node"), "left").select("meeting", "fp", F.coalesce("component", "fp").alias("root"))
    whole = Window.partitionBy("meeting")
    left = rooted.withColumn("lo", F.min("root").over(whole)).withColumn("hi", F.max("root").over(whole)).where("lo < hi")
    left = written(left.select(F.col("meeting").alias("family"), "fp", "root").join(classes.select("fp", "n"), "fp"), "jaccard-left")
    dropped(joined, meetings)
    rows = _placed(left, num, den, leaf_rows, leaf_tokens).join(classes.select("fp", "point"), "fp").select("block", "fp", "side", "n", "point", "root").repartition("block").sortWithinPartitions("block", "fp")
    met = written(rows.mapInArrow(partial(_met, num=num, den=den), "a long, b long").unionByName(close), "jaccard-met")
    out = connected_components(met, "jaccard-families")
    dropped(left, close, met)
    return out


def jaccard_components(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", leaf_rows: int = 4096, leaf_tokens: int = 1 << 21) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of num/den or more.

    Returns (id, n_shingles, component_id), a row for each row of ``docs``. A document's set
    is its distinct shingles of ``words`` lower-cased (A-Z) words, the whole sequence where it
    has fewer, and empty without words or text (null too): such a document is its own
    component. ``component_id`` is the smallest id reachable, null where no member has one. Rows
    that repeat an id with another text, and rows without an id, count as texts of their own.
    Other columns of ``docs``, whatever their names, play no part. A tree holds ``leaf_rows`` sets
    or ``leaf_tokens`` tokens; larger families take several, and every pair of them meets.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    signed = written(texts.mapInArrow(partial(_signed, words=words), "doc_id long, h long, n long, fp long, fp2 long, point binary"), "jaccard-signed")
    classes = written(signed.where("n > 0").groupBy("fp", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.min("h").alias("rep_h"), F.min("point").alias("point")), "jaccard-classes")
    families = _may_link(texts, classes, words, num, den, leaf_rows, leaf_tokens)
    alive = written(_placed(families.select(F.col("node").alias("fp"), F.col("component").alias("family")).join(classes.select("fp", "n"), "fp"), num, den, leaf_rows, leaf_tokens).select("block", "fp", "side"), "jaccard-alive")
    dropped(families)

    # the texts of what may link, each fetched once
    wanted = alive.groupBy("fp").agg(F.collect_list(F.struct("block", "side")).alias("places")).join(classes.select("fp", "rep", "rep_h"), "fp")
    named = texts.where("doc_id is not null").join(wanted, texts.doc_id == wanted.rep).select("fp", "places", "text")
    nameless = texts.where("doc_id is null").join(wanted.where("rep is null"), texts.h == wanted.rep_h).select("fp", "places", "text").dropDuplicates(["fp"])
    rows = named.unionByName(nameless).select("fp", "text", F.explode("places").alias("p")).select("p.block", "fp", "p.side", "text").repartition("block").sortWithinPartitions("block", "fp")
    links = written(rows.mapInArrow(partial(_families, words=words, num=num, den=den), "a long, b long"), "jaccard-links")
    dropped(alive)
    joined = connected_components(links, "jaccard-joined")
    dropped(links)

    named = classes.join(joined, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    roots = named.join(least, "root").select("fp", "fp2", "n", "component_id")
    out = signed.select("doc_id", "n", "fp", "fp2").join(roots, ["fp", "fp2", "n"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
