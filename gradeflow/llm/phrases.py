"""Phrase collocations by multikey three-way quicksort of suffix pointers (operator 12).

A first pass counts words. In the second every position whose word is frequent gives its
suffix, up to the longest phrase, the end of its piece or the first infrequent word. Suffixes
are routed by language and leading word; a leading word with very many of them is dealt on
by its second word, a pair of words with very many by the third. A task gathers whole routes and sorts pointers to their suffixes: each round splits every
open partition by a pivot word at its depth into less, equal and greater. The size of an equal partition is the
count of the prefix that its suffixes share, which then goes one word deeper; partitions
below the least count are abandoned at once.
"""

from __future__ import annotations

import zlib
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, dropped, slices, utf8, written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.int8)  # 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
#: Slots of the array that says of a word's hash how its suffixes are routed.
SLOTS = 1 << 20


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words, A-Z lower-cased, and the number of the piece that each lies in; no piece spans texts."""
    raw, offsets = utf8(texts)
    kind = _KIND[raw]
    inner = kind == 0
    head = inner.copy()
    head[1:] &= ~inner[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    head[first] = inner[first]
    cut = kind == 2
    piece = np.cumsum(cut) + np.cumsum(np.bincount(first, minlength=len(raw))[: len(raw)])
    text = _LOWER[raw[inner]]
    bounds = np.append(np.flatnonzero(head[inner]), len(text)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    return words.dictionary_encode(), piece[head]


def _by_lang(batches: Batches, most: int) -> Batches:
    """Slices of one language each."""
    for batch in slices(batches, "text", most, 1 << 16):
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, batch.filter(pc.equal(langs.indices, k)).column(1)


def _word_counts(batches: Batches) -> Batches:
    for lang, texts in _by_lang(batches, 4 << 20):
        words, _ = words_of(texts)
        n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        spelt = words.dictionary.cast(pa.string())
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(n) + 1), pa.string()), "phrase": pa.concat_arrays([spelt, pa.nulls(1, pa.string())]), "f": np.append(n, n.sum())})


def _slots(lang: str, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words, repeat(zlib.crc32(lang.encode() + b" "))), np.int64, len(words))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * 1_000_003 + second * 31) & 0xFFFFFFFF


def _pairs(batches: Batches, ways: np.ndarray) -> Batches:
    """Of leading words that are dealt on, how many pairs fall into each slot."""
    for lang, texts in _by_lang(batches, 4 << 20):
        words, piece = words_of(texts)
        if len(words) > 1:
            hashes = _slots(lang, words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
            both = (piece[1:] == piece[:-1]) & (ways[hashes[:-1] % SLOTS] > 1)
            slot, n = np.unique(_pair(hashes[:-1][both], hashes[1:][both]) % SLOTS, return_counts=True)
            yield pa.RecordBatch.from_pydict({"slot": slot, "n": n})


def _suffixes(batches: Batches, ways: np.ndarray, pair_ways: np.ndarray, depth: int) -> Batches:
    """Distinct suffixes of each slice by leading word, each with its count."""
    for lang, texts in _by_lang(batches, 2 << 20):
        words, piece = words_of(texts)
        if not len(words):
            continue
        spelt = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = _slots(lang, spelt)
        split = ways[hashes % SLOTS].astype(np.int64)
        frequent = np.flatnonzero(split)
        names = pa.array([spelt[k] for k in frequent.tolist()], pa.binary()).cast(pa.string())
        split, hashes = split[frequent], hashes[frequent]
        dense = np.zeros(len(spelt), np.int64)
        dense[frequent] = np.arange(1, len(frequent) + 1)
        code = dense[words.indices.to_numpy()]
        rows = np.zeros((depth, len(code)), np.int64)
        rows[0] = code
        on = code > 0
        for k in range(1, depth):  # a suffix ends with its piece or before an infrequent word
            on = on[:-1] & (piece[k:] == piece[: len(code) - k]) & (code[k:] > 0) if len(on) > 1 else on[:0]
            rows[k, : len(on)] = np.where(on, code[k:], 0)
        rows = rows[:, rows[1] > 0]
        if not rows.shape[1]:
            continue
        wide, keys = len(frequent) + 1, rows[0]
        for k in range(1, depth):  # number the distinct prefixes, one word more each time
            _, keys = np.unique(keys * wide + rows[k], return_inverse=True)
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        rows = rows[:, first] - 1
        way = split[rows[0]]
        pair = _pair(hashes[rows[0]], hashes[rows[1]])
        third = np.where(rows[2] >= 0, hashes[rows[2]], 1) if depth > 2 else np.int64(1)
        pair_way = np.where(way > 1, pair_ways[pair % SLOTS], 0)
        # parts below zero hold pairs that lie in several parts
        part = np.where(pair_way > 1, -1 - (pair + third) % np.maximum(pair_way, 1), hashes[rows[1]] % way)
        order = np.lexsort((part, rows[0]))
        rows, n, part = rows[:, order], n[order], part[order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(part) != 0)]))
        bounds = pa.array(np.append(heads, len(n)).astype(np.int32))
        tails = [names.take(pa.array(np.maximum(r, 0), mask=r < 0)) for r in rows[1:]]
        tails = pc.binary_join_element_wise(*tails, pa.scalar(" "), null_handling="skip")
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(heads), pa.string()), "lead": names.take(pa.array(rows[0][heads])), "part": part[heads], "tails": pa.ListArray.from_arrays(bounds, tails), "n": pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int32)))})


def equal_partitions(keys: np.ndarray, weight: np.ndarray, route: np.ndarray, least: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Prefixes and their counts by three-way quicksort: (a pointer to each, words in it, count).

    ``keys`` holds a column for each suffix, -1 behind its end; ``route`` numbers the partitions to begin
    with and ``least`` (depth, route) says which sizes are kept. All open partitions are split in one round.
    """
    rng, out = np.random.default_rng(seed), []
    depth_most = len(keys)
    pointer = np.argsort(route, kind="stable")
    part = route[pointer]
    depth = np.zeros(len(pointer), np.int64)
    while len(pointer):
        heads = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
        sizes = np.diff(np.append(heads, len(part)))
        number = np.repeat(np.arange(len(heads)), sizes)
        word = keys[depth, pointer]
        # pivot: the middle of three of the partition's words
        three = [word[heads + (rng.random(len(heads)) * sizes).astype(np.int64)] for _ in range(3)]
        pivot = np.maximum(np.minimum(three[0], three[1]), np.minimum(np.maximum(three[0], three[1]), three[2]))[number]
        side = (word >= pivot).astype(np.int8) + (word > pivot)
        order = np.argsort(number * 3 + side, kind="stable")
        pointer, depth, word, side, number = (x[order] for x in (pointer, depth, word, side, number))
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(number) != 0) | (np.diff(side) != 0)]))
        sizes = np.diff(np.append(heads, len(number)))
        total = np.add.reduceat(weight[pointer], heads)
        enough = total >= least[depth[heads], route[pointer[heads]]]
        equal = side[heads] == 1
        ended = equal & (word[heads] < 0)  # suffixes that are over: nothing lies deeper
        told = equal & enough & ~ended
        out.append((pointer[heads[told]], depth[heads[told]] + 1, total[told]))
        deeper = equal & ~ended & (depth[heads] + 1 < depth_most)
        # one word deeper only what the next depth could keep
        deeper[deeper] = total[deeper] >= least[depth[heads[deeper]] + 1, route[pointer[heads[deeper]]]]
        keep = np.repeat((~equal & enough) | deeper, sizes)
        depth = depth + np.repeat(deeper, sizes)
        part = np.repeat(np.arange(len(heads)), sizes)
        pointer, part, depth = pointer[keep], part[keep], depth[keep]
    return out


def _sorted(batches: Batches, least: int, depth: int, chunk: int) -> Batches:
    """Gather whole routes of a sorted partition, ``chunk`` suffixes at a time, and count their prefixes."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def mined(t: pa.Table) -> pa.RecordBatch:
        lists = t.column("tails").combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        weight = t.column("n").combine_chunks().flatten().to_numpy().astype(np.int64)
        same = np.concatenate([[True], np.logical_or.reduce([np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))) for c in (t.column(k).combine_chunks() for k in ("lang", "lead", "part"))])])
        first = np.flatnonzero(same)
        route = np.repeat(np.cumsum(same) - 1, size)
        split = t.column("part").to_numpy()[first] < 0
        spelt = pc.split_pattern(lists.flatten(), " ")
        words = spelt.flatten().dictionary_encode()
        lengths = pc.list_value_length(spelt).to_numpy().astype(np.int64)
        keys = np.full((depth - 1, len(lengths)), -1, np.int64)
        column = np.repeat(np.arange(len(lengths)), lengths)
        keys[np.arange(len(column)) - np.repeat(np.cumsum(lengths) - lengths, lengths), column] = words.indices.to_numpy()
        wanted = np.full((depth - 1, len(first)), least, np.int64)
        wanted[0, split] = 1  # these pairs lie in several routes
        got = equal_partitions(keys, weight, route, wanted)
        at, deep, f = (np.concatenate([g[k] for g in got] or [np.zeros(0, np.int64)]) for k in range(3))
        parts = [pc.take(t.column("lead").combine_chunks(), pa.array(first[route[at]]))]
        for k in range(depth - 1):
            code = np.where(k < deep, keys[k, at], -1)
            parts.append(words.dictionary.take(pa.array(np.maximum(code, 0), mask=code < 0)))
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" "), null_handling="skip")
        return pa.RecordBatch.from_pydict({"lang": pc.take(t.column("lang").combine_chunks(), pa.array(first[route[at]])), "phrase": phrase, "words": (deep + 1).astype(np.int32), "f": f, "whole": ~(split[route[at]] & (deep == 1))})

    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += len(batch.column(batch.schema.get_field_index("tails")).flatten())
        if rows and (batch is None or rows >= chunk):
            t = pa.Table.from_batches(held).combine_chunks()
            stop = t.num_rows
            if batch is not None:  # the last route may go on in the next batch
                same = np.logical_and.reduce([np.asarray(pc.equal(t.column(k), t.column(k)[stop - 1])) for k in ("lang", "lead", "part")])
                other = np.flatnonzero(~same)
                stop = int(other[-1]) + 1 if len(other) else 0
            if stop:
                yield mined(t.slice(0, stop))
            held = t.slice(stop).to_batches()
            rows = sum(len(b.column(b.schema.get_field_index("tails")).flatten()) for b in held)


def phrase_counts(docs: DataFrame, *, least: int = 30, depth: int = 4, route_rows: int = 1_000_000, chunk: int = 300_000, sample: float = 1 / 64, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``depth`` words that occur ``least`` times, and (lang, n).

    A leading word with more than ``route_rows`` occurrences is dealt on in as many parts as
    that takes, and so is a pair of such a word; which pairs have so many is estimated from a ``sample`` of the rows, and
    decides how rows are dealt, never a count. What executors need of these counts is two arrays of ``SLOTS``
    numbers by hash, whatever the vocabulary; a slot that words share makes more work, never another count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    single = written(rows.mapInArrow(_word_counts, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(f"phrase is null or f >= {least}"), "phrases-words")
    slot = F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary")) % SLOTS
    told = single.where("phrase is not null").groupBy(slot.alias("slot")).agg(F.max(F.ceil(F.col("f") / route_rows)).alias("ways")).toPandas()
    ways = np.zeros(SLOTS, np.int32)
    ways[told.slot.to_numpy(np.int64)] = told.ways.to_numpy(np.int64)
    pair_ways = np.zeros(SLOTS, np.int32)
    if ways.max() > 1:
        one = spark.sparkContext.broadcast(ways)
        some = rows.sample(fraction=sample, seed=12).mapInArrow(lambda batches: _pairs(batches, one.value), "slot long, n long")
        many = some.groupBy("slot").agg(F.ceil(F.sum("n") / (sample * route_rows)).alias("ways")).where("ways > 1").toPandas()
        pair_ways[many.slot.to_numpy(np.int64)] = many.ways.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((ways, pair_ways))
    suffixes = rows.mapInArrow(lambda batches: _suffixes(batches, *shared.value, depth), "lang string, lead string, part long, tails array<string>, n array<int>")
    keys = ["lang", "lead", "part"]
    dealt = suffixes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    got = written(dealt.mapInArrow(partial(_sorted, least=least, depth=depth, chunk=chunk), "lang string, phrase string, words int, f long, whole boolean"), "phrases-found")
    summed = got.where("not whole").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(f"f >= {least}")
    one = single.where("phrase is not null").selectExpr("lang", "phrase", "1 as words", "f")
    return one.unionByName(got.where("whole").drop("whole")).unionByName(summed), single.where("phrase is null").selectExpr("lang", "f as n")


def collocations(docs: DataFrame, *, least: int = 30, depth: int = 4, scale: int = 2_000_000, covered: int = 80, top: int = 2_000, parts: int = 32, **how: int | str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``depth`` words.

    Words are runs without space and tab, A-Z lower-cased; phrases do not cross ``.,;:!?`` and line breaks. ``a`` is the
    phrase's count; of its cuts into two parts with counts ``l`` and ``r`` that with the least
    floor(scale * a / (l + r)) counts, of equal ones the earliest. A phrase inside a longer one
    that has at least ``covered`` percent of its count is dropped. Order: score and ``a`` descending, phrase by bytes. ``n`` are
    the language's words. Null languages are ``und``, null and empty texts have no words; repeated rows count each time; long
    texts count whole; an empty table has no rows. Arithmetic is decimal where a product may pass 64 bits.
    """
    counts, sizes = phrase_counts(docs, least=least, depth=depth, **how)
    counts = written(counts, "phrases-counts")
    wide = "decimal(20, 0)"
    phrases = counts.where("words > 1")
    cuts = phrases.selectExpr("lang", "phrase", "f as a", "explode(sequence(1, words - 1)) as k").selectExpr("*", "substring_index(phrase, ' ', k) as first")
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = counts.selectExpr("lang", "phrase as first", "f as l")
    right = counts.selectExpr("lang", "phrase as rest", "f as r")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(f"(cast({scale} as decimal(10, 0)) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = "flatten(transform(sequence(2, words - 1), k -> transform(sequence(0, words - k), i -> array_join(slice(w, i + 1, k), ' '))))"
    inside = counts.where("words > 2").selectExpr("lang", "f", "words", "split(phrase, ' ', -1) as w").selectExpr("lang", "f", f"explode({inner}) as phrase").groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(f"outer is null or cast(100 as decimal(3, 0)) * cast(outer as {wide}) < cast({covered} as decimal(3, 0)) * cast(a as {wide})")
    ranked = kept.select("lang", "phrase", "a", "cut.*").withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for by in (["lang", "_part"], ["lang"]):  # first in parts, so that no task sorts a whole language
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
