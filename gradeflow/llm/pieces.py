"""SentencePiece encoding and decoding by vectorised merge rounds (operator 11).

Texts are cut into words: a run of white-space marks and what follows up to the next run. No
piece of such a model reaches over that border, so a word's ids do not depend on its
neighbours. All unknown words of a slice lie in one flat array of symbols. A round finds in
every word the pair whose piece has the best score, merges its occurrences from the left at
once, and takes words without a mergeable pair out of the array; it ends when none is left.
Characters without a piece become the ids of their bytes. A task holds one slice of texts
and a bounded memory of words, whatever the size of a partition.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, slices, utf8

#: The character that stands for a space in pieces (a fixed value of the format).
MARK = "▁"
_NONE = np.int32(2**31 - 1)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)


class Pieces:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix, as symbol tables."""

    def __init__(self, path: str, most: int = 200_000, most_bytes: int = 16 << 20) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.end_id, self.most, self.most_bytes = model.eos_id(), most, most_bytes
        size = model.get_piece_size()
        text = {i: model.id_to_piece(i) for i in range(size)}
        byte = {i: int(text[i][1:-1], 16) for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # symbols: pieces under their ids, then characters that only occur within pieces, then the unknown one
        symbols = {text[i]: i for i in plain}
        for c in sorted({c for i in plain for c in text[i]} - symbols.keys()):
            symbols[c] = size + len(symbols) - len(plain)
        self.unknown = size + len(symbols) - len(plain)
        self.width = self.unknown + 1
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        # the rank of a piece: how many distinct scores are better
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = np.full(self.width + 1, _NONE, np.int32)
        for i in plain:
            self.rank[i] = place[model.get_score(i)]
        pairs = {symbols[text[i][:k]] * self.width + symbols[text[i][k:]]: i for i in plain for k in range(1, len(text[i])) if text[i][:k] in symbols and text[i][k:] in symbols}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.may_pair = np.zeros(1 << 21, bool)  # most pairs make no piece; this tells them without a search
        self.may_pair[_slot(self.pair_keys)] = True
        self.byte_id = np.zeros(256, np.int32)
        for i, b in byte.items():
            self.byte_id[b] = i
        self.piece_ids = np.zeros(self.width, bool)
        self.piece_ids[plain] = True
        # what each id decodes to
        spelt = [bytes([byte[i]]) if i in byte else text[i].replace(MARK, " ").encode() if self.piece_ids[i] else " ⁇ ".encode() if model.is_unknown(i) else b"" for i in range(size)]
        self.out_at = np.concatenate([[0], np.cumsum([len(s) for s in spelt])])
        self.out = np.frombuffer(b"".join(spelt), np.uint8)
        # Long runs of marks fall into pieces of the longest run from the left, whatever follows, if all their pieces share the
        # worst score of all and so grow one after the other; such runs are cut before they are merged.
        runs = [i for i in plain if len(text[i]) > 1 and not text[i].strip(MARK)]
        rest = min((model.get_score(i) for i in plain if len(text[i]) > 1 and text[i].strip(MARK)), default=0.0)
        self.longest_run = 0
        if runs and len({model.get_score(i) for i in runs}) == 1 and model.get_score(runs[0]) < rest:
            longest = max(len(text[i]) for i in runs)
            got = self.merged(np.full(3 * longest, self.of_char[ord(MARK)]), np.zeros(3 * longest, np.int64))[2]
            self.longest_run = longest if got.tolist() == [0, longest, 2 * longest] else 0
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends, self.held = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def _pieces_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or ``width``."""
        key = a.astype(np.int64) * self.width + b
        out = np.full(len(key), self.width, np.int32)
        some = np.flatnonzero(self.may_pair[_slot(key)])
        key = key[some]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out[some] = np.where(self.pair_keys[at] == key, self.pair_piece[at], self.width)
        return out

    def merged(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge until no pair is left: symbols, their words, and the position of their first character.

        ``words`` numbers the words, without gaps and in order. Of one word's pairs with the best
        rank the leftmost goes first; the rest of them follow in the same round unless a merge
        made a pair that is at least as good.
        """
        place, done = np.arange(len(symbols)), []
        makes = np.full(len(symbols), self.width, np.int32)
        inside = words[1:] == words[:-1]
        makes[:-1][inside] = self._pieces_of(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            ranks = self.rank[makes]
            starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            sizes = np.diff(np.append(starts, len(words)))
            best = np.minimum.reduceat(ranks, starts)
            if (best == _NONE).any():
                over = np.repeat(best == _NONE, sizes)
                done.append((symbols[over], words[over], place[over]))
                symbols, words, place, makes, ranks = (x[~over] for x in (symbols, words, place, makes, ranks))
                best, sizes = best[best != _NONE], sizes[best != _NONE]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            run = np.flatnonzero(np.diff(hits, prepend=-9) != 1)  # of pairs that overlap every other one goes
            hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))) % 2 == 0]
            several = np.flatnonzero(words[hits][1:] == words[hits][:-1])
            if len(several):
                hits = self._in_turn(hits, symbols, words, makes, ranks)
            symbols[hits] = makes[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # one symbol left the array before each later hit
            symbols, words, place, makes = (x[keep] for x in (symbols, words, place, makes))
            for p in (at, at[at > 0] - 1):
                makes[p] = self.width
                p = p[p + 1 < len(words)]
                p = p[words[p] == words[p + 1]]
                makes[p] = self._pieces_of(symbols[p], symbols[p + 1])
        if not done:
            return symbols, words, place
        symbols, words, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return symbols[order], words[order], place[order]

    def _in_turn(self, hits: np.ndarray, symbols: np.ndarray, words: np.ndarray, makes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Those hits of each word that go before a merge makes a pair as good as they are."""
        new, size = makes[hits], len(symbols)
        left, right = np.maximum(hits - 1, 0), np.minimum(hits + 2, size - 1)
        before = symbols[left].copy()
        joined = np.flatnonzero(np.diff(hits, prepend=-9) == 2)  # the hit before made the left neighbour
        joined = joined[words[hits[joined]] == words[hits[joined - 1]]]
        before[joined] = new[joined - 1]
        made = np.full((2, len(hits)), _NONE, np.int32)
        ok = (hits > 0) & (words[left] == words[hits])
        made[0, ok] = self.rank[self._pieces_of(before[ok], new[ok])]
        ok = (hits + 2 < size) & (words[right] == words[hits])
        made[1, ok] = self.rank[self._pieces_of(new[ok], symbols[right][ok])]
        stop = made.min(0) <= ranks[hits]
        first = np.flatnonzero(np.concatenate([[True], np.diff(words[hits]) != 0]))
        stopped = np.cumsum(stop) - stop
        return hits[stopped == np.repeat(stopped[first], np.diff(np.append(first, len(hits))))]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the number of ids of each."""
        text = b"".join(words).decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        points = np.where(points == 32, ord(MARK), points)
        raw = np.frombuffer(b"".join(words), np.uint8)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
        ends = heads[np.cumsum([len(w) for w in words])]
        number = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        symbols, number, place = self.merged(self.of_char[points], number)
        known = self.piece_ids[symbols]
        spelt = {p: np.frombuffer(chr(p).encode(), np.uint8) for p in np.unique(points[place[~known]]).tolist()}
        size = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(~known)
        size[odd] = [len(spelt[p]) for p in points[place[odd]].tolist()]
        ids = np.repeat(symbols, size)
        at = np.cumsum(size) - size
        for i in odd.tolist():
            b = spelt[int(points[place[i]])]
            ids[at[i] : at[i] + len(b)] = self.byte_id[b]
        return ids, np.bincount(number, weights=size, minlength=len(words)).astype(np.int64)

    def _learn(self, words: list[bytes]) -> None:
        ids, counts = self._encoded(words)
        n, used = len(self.known), int(self.ends[len(self.known)])
        ends = used + np.cumsum(counts)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : ends[-1]] = ids
        self.ends[n + 1 : n + 1 + len(words)] = ends
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.held += sum(map(len, words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null as empty, no end id) and each text's offset into them."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        some = pc.not_equal(pc.binary_length(texts), 0)
        texts = pc.if_else(some, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())), texts)
        raw, offsets = utf8(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = raw == 32
        head = np.empty(len(raw), bool)
        head[0] = True
        head[1:] = space[1:] & ~space[:-1]
        head[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.longest_run:
            begin = np.flatnonzero(head & space)
            after = np.flatnonzero(~space)
            length = np.append(after, len(raw))[np.searchsorted(after, begin)] - begin
            row_end = offsets[np.searchsorted(offsets, begin, side="right")]
            length = np.minimum(length, row_end - begin)
            for k in np.flatnonzero(length > self.longest_run).tolist():
                head[begin[k] : begin[k] + length[k] : self.longest_run] = True
        starts = np.flatnonzero(head)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        if len(self.known) + len(words.dictionary) > self.most or self.held > self.most_bytes:
            self.clear()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            self._learn(fresh)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        length = self.ends[number + 1] - self.ends[number]
        ends = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(ends[-1], np.int32)
        for a in range(0, len(number), 1 << 16):  # so few at a time that they stay in the processor's cache
            b = min(a + (1 << 16), len(number))
            shift = self.ends[number[a:b]] - (ends[a:b] - ends[a])
            out[ends[a] : ends[b]] = self.ids[np.arange(ends[b] - ends[a]) + np.repeat(shift, length[a:b])]
        return out, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of lists of ids, given flat with offsets; one space before a text's first piece goes.

        Control ids have no text. Bytes that make no character become U+FFFD.
        """
        size = (self.out_at[1:] - self.out_at[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = np.empty(ends[-1], np.uint8)
        for a in range(0, len(ids), 1 << 16):
            b = min(a + (1 << 16), len(ids))
            shift = self.out_at[ids[a:b]] - (ends[a:b] - ends[a])
            raw[ends[a] : ends[b]] = self.out[np.arange(ends[b] - ends[a]) + np.repeat(shift, size[a:b])]
        bounds = ends[offsets]
        begin = bounds[:-1].copy()
        some = np.flatnonzero(np.diff(bounds) > 0)
        first = some[raw[begin[some]] == 32]
        # a first space goes only where a piece put it there, not an id of a byte
        head = np.searchsorted(ends, begin[first], side="right") - 1
        begin[first[self.piece_ids[ids[head]]]] += 1
        body = raw.tobytes()
        return pa.array([body[a:b].decode(errors="replace") for a, b in zip(begin.tolist(), bounds[1:].tolist(), strict=True)], pa.large_string())


def _run(batches: Batches, model: str, end: bool, decode: bool) -> Batches:
    pieces = Pieces(model)
    for batch in slices(batches, "text", 2 << 20):
        ids, offsets = pieces.encode(batch.column(1))
        if end:
            ids = np.insert(ids, offsets[1:], pieces.end_id)
            offsets = offsets + np.arange(len(offsets))
        out = {"id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))}
        if decode:
            out["decoded"] = pieces.decode(ids, offsets).cast(pa.string())
        yield pa.RecordBatch.from_pydict(out)


def encoded(docs: DataFrame, *, model: str, end: bool = True, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row of ``docs``, with ``decode`` also (decoded), the text of the ids.

    ``model`` is the path of a BPE model with byte fallback that every executor has; ids are those
    of the sentencepiece library without sampling. ``end`` closes each text with the end
    id. Null texts are empty, and those have the end id only; rows that repeat an id, or have none, each keep a row;
    an empty table has no rows; other columns are not read. Texts of any length are encoded whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_run, model=model, end=end, decode=decode), f"id {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def _back(batches: Batches, model: str) -> Batches:
    pieces = Pieces(model)
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pc.if_else(lists.is_valid(), pieces.decode(flat, offsets).cast(pa.string()), None)})


def decoded(rows: DataFrame, *, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row's ids; null ids have a null text. Ids outside the model are an error."""
    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col(id_col).alias("id"), F.filter(F.col(ids_col).cast("array<int>"), lambda i: i.isNotNull()).alias("ids"))
    return picked.mapInArrow(partial(_back, model=model), f"id {kind}, text string").withColumnRenamed("id", id_col)
