"""Spelling variants: sorted-list dynamic programming over a vocabulary (operator 13).

Two words one edit apart agree before the edit and after it, so each word is filed under what
it shares with such a partner: its first half (an edit behind it) and its second half (an edit
before it). A file with many words is cut again in the same way, half of the rest at a time, until
it is small; when one place is left, a file holds no more words than there are letters.
Within a file the words stand sorted. Each word scans that list with the three cells of its
edit matrix that one edit can reach, keeps the rows of the prefix that the next word shares with
the last one, and skips the range of words whose shared prefix already costs more than one edit.
All words of a chunk of files scan in step.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, dropped, slices, utf8, written

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, and each row's offset into them."""
    raw, offsets = utf8(texts)
    letter = _ASCII[raw]
    lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF are this byte and one more
    letter[lead] = letter[lead + 1] = True
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    head[first] = letter[first]
    heads = np.flatnonzero(head[letter])
    text = _LOWER[raw[letter]]
    bounds = np.append(heads, len(text)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    return words.dictionary_encode(), np.searchsorted(np.flatnonzero(head), offsets)


def _counted(batches: Batches, noise: int, least: int) -> Batches:
    """Counts of the words of each slice; for one of ``noise`` (row, word) a code point is left out."""
    for batch in slices(batches, "text", 4 << 20, 1 << 16):
        words, at = runs(batch.column(1))
        spelt = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(at))
        key, n = np.unique(rows * len(spelt) + words.indices.to_numpy(), return_counts=True) if len(spelt) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        row, code = key // max(1, len(spelt)), key % max(1, len(spelt))
        ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()]
        h = np.fromiter(map(zlib.crc32, map(spelt.__getitem__, code.tolist()), map(ids.__getitem__, row.tolist())), np.int64, len(key))
        cut = np.flatnonzero(h % noise == 0) if noise else np.zeros(0, np.int64)
        total = np.bincount(code, weights=n, minlength=len(spelt)).astype(np.int64)
        np.subtract.at(total, code[cut], n[cut])
        found: Counter[str] = Counter()
        for k in cut.tolist():
            word = spelt[code[k]].decode()
            drop = int(h[k]) % len(word)
            found[word[:drop] + word[drop + 1 :]] += int(n[k])
        texts = [w.decode() for w in spelt]
        keep = [k for k in np.flatnonzero(total).tolist() if len(texts[k]) >= least]
        more = [w for w in found if len(w) >= least]
        yield pa.RecordBatch.from_pydict({"word": pa.array([texts[k] for k in keep] + more, pa.string()), "n": pa.array(total[keep].tolist() + [found[w] for w in more], pa.int64())})


def vocabulary(docs: DataFrame, *, least_points: int = 6, least_n: int = 5, noise: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of ``least_points`` code points and ``least_n`` occurrences at least, in all texts.

    With ``noise`` a word of a row whose crc32 of ``<id>:<word>`` that number divides loses the
    code point crc32 % length. A null id counts as empty there; null texts have no words.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = rows.mapInArrow(lambda batches: _counted(batches, noise, least_points), "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _table() -> np.ndarray:
    """The next row of the banded matrix: by 8 * (the row's three cells, each 0 to 2) + which of three letters match."""
    out = np.zeros(27 * 8, np.uint8)
    for row in range(27):
        p = (row // 9, row // 3 % 3, row % 3)
        for m in range(8):
            a = min(2, p[0] + (not m & 4), p[1] + 1)
            b = min(2, p[1] + (not m & 2), p[2] + 1, a + 1)
            c = min(2, p[2] + (not m & 1), b + 1)
            out[8 * row + m] = 9 * a + 3 * b + c
    return out


_NEXT = _table()
_FIRST = 9 * 2 + 3 * 0 + 1  # before any letter: out of the matrix, 0, 1
_DEAD = 26
#: Cost of a candidate that is one letter shorter, as long, one longer: the cell it is read from.
_CELL = np.array([[r % 3, r // 3 % 3, r // 9] for r in range(27)], np.uint8)


class Sorted:
    """Sorted lists of words, one after the other, as bytes (latin-1), with the prefix each word shares with the one before."""

    def __init__(self, words: list[bytes], file: np.ndarray) -> None:
        self.size = np.array([len(w) for w in words], np.int64)
        # a zero stands before each word and two behind it, so letters beyond a word match nothing
        self.raw = np.frombuffer(b"".join(b"\0" + w + b"\0\0" for w in words) or b"\0", np.uint8)
        self.at = np.cumsum(self.size + 3) - self.size - 2
        n = len(words)
        self.shared = np.full(n + 1, -1, np.int64)  # -1: the first word of a list, or behind the last
        alive = np.flatnonzero(file[1:] == file[:-1]) + 1
        self.shared[alive] = 0
        depth = 0
        while len(alive):
            alive = alive[(self.raw[self.at[alive] + depth] == self.raw[self.at[alive - 1] + depth]) & (self.raw[self.at[alive] + depth] > 0)]
            depth += 1
            self.shared[alive] = depth
        # the next word that shares less with its predecessor than this one
        self.less = np.full(n + 1, n, np.int64)
        stack: list[int] = []
        for k, s in enumerate(self.shared.tolist()):
            while stack and self.shared[stack[-1]] > s:
                self.less[stack.pop()] = k
            stack.append(k)
        self.start = np.maximum.accumulate(np.where(self.shared[:-1] < 0, np.arange(n), 0))

    def near(self, asking: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asking word, word of its list) that are one edit apart."""
        got = [self._near(asking[k : k + most]) for k in range(0, len(asking), most)]
        return np.concatenate([g[0] for g in got] or [np.zeros(0, np.int64)]), np.concatenate([g[1] for g in got] or [np.zeros(0, np.int64)])

    def _near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[q]
        base = np.cumsum(size + 3) - size - 3  # each asking word keeps the rows of the prefix it has read
        rows = np.full(int((size + 3).sum()), _DEAD, np.uint8)
        rows[base] = _FIRST
        at, c, depth = self.at[q], self.start[q].copy(), np.zeros(len(q), np.int64)
        left, right = [], []
        while len(q):
            letter = self.raw[self.at[c] + depth]
            here = at + np.minimum(depth, size + 1)  # behind the word stand zeros, which match nothing
            match = 4 * (self.raw[here - 1] == letter) + 2 * (self.raw[here] == letter) + (self.raw[np.minimum(here + 1, at + size)] == letter)
            state = _NEXT[8 * rows[base + depth].astype(np.int64) + match]
            depth += 1
            rows[base + np.minimum(depth, size + 2)] = state
            dead = state == _DEAD
            ended = ~dead & (depth == self.size[c])
            if ended.any():
                e = np.flatnonzero(ended)
                gap = self.size[c[e]] - size[e]
                e = e[np.abs(gap) <= 1]
                e = e[_CELL[state[e], self.size[c[e]] - size[e] + 1] == 1]
                left.append(q[e])
                right.append(c[e])
            move = np.flatnonzero(dead | ended)
            if not len(move):
                continue
            to, deep = c[move] + 1, depth[move]
            skip = np.flatnonzero(dead[move] & (self.shared[to] >= deep))
            while len(skip):  # of the words that share the prefix just read
                to[skip] = self.less[to[skip]]
                skip = skip[self.shared[to[skip]] >= deep[skip]]
            c[move] = to
            depth[move] = self.shared[to]
            over = move[self.shared[to] < 0]
            if len(over):
                keep = np.ones(len(q), bool)
                keep[over] = False
                q, size, base, at, c, depth = (x[keep] for x in (q, size, base, at, c, depth))
        return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def _scanned(words: list[str], counts: np.ndarray, file: np.ndarray, base: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Of whole files, sorted: each word's near words, counted, and the best of them."""
    lists = Sorted([w.encode("latin-1") for w in words], file)
    size = lists.size
    a, b = lists.near(np.flatnonzero(size == base))  # a file belongs to the shorter word's length
    keep = (size[b] >= base[a]) & (a != b)
    a, b = a[keep], b[keep]
    # an edit behind the file's last place has the word in the other half's file
    same, depth = np.arange(len(a)), 0
    inside = np.ones(len(a), bool)
    while len(same):
        same = same[lists.raw[lists.at[a[same]] + depth] == lists.raw[lists.at[b[same]] + depth]]
        same = same[size[a[same]] > depth]
        depth += 1
        inside[same[last[a[same]] < depth]] = False
        same = same[inside[same]]
    a, b = a[inside], b[inside]
    longer = size[b] > size[a]  # pairs of one length are met from both ends
    a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    order = np.lexsort((b, -counts[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    best = b[first].tolist()
    return pa.RecordBatch.from_pydict({"word": pa.array([words[k] for k in a[first].tolist()], pa.string()), "n_near": np.diff(np.append(first, len(a))), "form": pa.array([words[k] for k in best], pa.string()), "form_n": counts[best] if best else np.zeros(0, np.int64)})


def _files(batches: Batches, chunk: int) -> Batches:
    """Gather whole files of a sorted partition, about ``chunk`` words at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def scan(part: pa.Table) -> pa.RecordBatch:
        spelt = part.column("word").to_pylist()
        key = part.select(["base", "first", "last", "key"]).to_pandas()
        file = (key != key.shift()).any(axis=1).cumsum().to_numpy()
        return _scanned(spelt, part.column("n").to_numpy(), file, key["base"].to_numpy(), key["last"].to_numpy())

    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
        if rows and (batch is None or rows >= chunk):
            part = pa.Table.from_batches(held).combine_chunks()
            stop = part.num_rows
            if batch is not None:  # the last file may go on in the next batch
                names = ("base", "first", "last", "key")
                end = [part.column(n)[stop - 1].as_py() for n in names]
                same = np.logical_and.reduce([np.asarray(pa.compute.equal(part.column(n), e)) for n, e in zip(names, end, strict=True)])
                other = np.flatnonzero(~same)
                stop = int(other[-1]) + 1 if len(other) else 0
            if stop:
                yield scan(part.slice(0, stop))
            held = part.slice(stop).to_batches()
            rows = part.num_rows - stop


def _key(word: str, base: str, first: str, last: str) -> Column:
    """What words of ``base`` letters, and one more, share if the edit is at places ``first`` to ``last``."""
    tail = f"({base} - 1 - {last})"
    return F.expr(f"concat(substring({word}, 1, {first}), '\\u0000', CASE WHEN {tail} > 0 THEN right({word}, {tail}) ELSE '' END)")


def _halved(rows: DataFrame) -> DataFrame:
    """Each row once for an edit in the first and once for one in the second half of its places."""
    half = F.expr("inline(array(struct((first + last + 1) div 2 as f, last as l), struct(first as f, (first + last + 1) div 2 - 1 as l)))")
    cut = rows.select("word", "n", "base", half).where("f <= l")
    return cut.select("word", "n", "base", F.col("f").alias("first"), F.col("l").alias("last"), _key("word", "base", "f", "l").alias("key"))


def near_words(words: DataFrame, *, most: int = 20_000, chunk: int = 100_000, parts: int | None = None) -> DataFrame:
    """(word, n_near, form, form_n) from (word, n): the number of words one edit away and the most frequent of them.

    Of equal counts the first in code-point order. Words are distinct, made of code points below
    256 and of two at least. A word without a near word has no row. Files above ``most`` words
    are cut further, so a task holds ``chunk`` words and one file, however words cluster.
    """
    spark = words.sparkSession
    # a word of length m meets words as long and one longer in files of m, words one shorter in those of m - 1
    rows = words.selectExpr("word", "n", "explode(array(length(word), length(word) - 1)) as base").selectExpr("word", "n", "base", "0 as first", "base as last")
    files = _halved(rows.where("base > 0"))
    ready = []
    keys = ["base", "first", "last", "key"]
    while True:
        sizes = files.groupBy(*keys).agg(F.count("*").alias("size"), F.count(F.expr("CASE WHEN length(word) = base THEN 1 END")).alias("asking"))
        large = written(sizes.where(f"size > {most} and asking > 0 and last > first").select(*keys), "spelling-large")
        if large.isEmpty():
            dropped(large)
            ready.append(files)
            break
        ready.append(files.join(large, keys, "left_anti"))
        files = written(_halved(files.join(large, keys, "left_semi")), "spelling-files")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(parts, *keys).sortWithinPartitions(*keys, "word")
    found = dealt.mapInArrow(lambda batches: _files(batches, chunk), "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).selectExpr("word", "n_near", "best.form as form", "-best.less as form_n")


def spelling_forms(words: DataFrame, *, times: int = 5, **how: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of (word, n).

    ``form`` is the most frequent near word if it is ``times`` (2 at least) as frequent as the word, else null;
    ``root`` is the last word that forms lead to, the word itself if it has none. Counts grow along forms, so
    they end; each round of joins doubles the steps taken. An empty vocabulary has no rows.
    """
    words = written(words, "spelling-words")
    near = near_words(words, **how)
    all_words = words.join(near, "word", "left").withColumn("_has", F.col("form_n") >= times * F.col("n"))
    told = written(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("CASE WHEN _has THEN form END").alias("form"), F.expr("CASE WHEN _has THEN form_n END").alias("form_n")), "spelling-forms")
    most, steps = told.agg(F.max("n")).first()[0] or 1, 1
    while times**steps < most:
        steps += 1
    hops = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("then"))
        nearer, hops = hops, written(hops.join(ahead, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "spelling-roots")
        if hasattr(nearer, "_written_at"):
            dropped(nearer)
    dropped(words)
    return told.join(hops, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
