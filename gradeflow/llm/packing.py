"""Sum-of-squares online packing of token sequences (operator 4).

Documents are cut into pieces of the window's length, which fill a sequence each, and a
rest. Each rest goes, as it comes, to the fill level where the sum of the squared counts
of partly filled windows grows least: opening a window, topping one up or filling one all
change the counts of two levels. Documents are dealt to blocks by their id and packed
block by block in one stream: a task holds the level array, one batch of texts and the
numbers of open windows, whatever the size of the block.
"""

from __future__ import annotations

from functools import partial
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, slices, utf8


_KIND = np.zeros(256, np.int8)  # 1: ASCII letters and digits, 2: ASCII marks but the apostrophe, 3: white space
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokenised:
    """Ids of whole texts by a lower-casing word-end BPE file, through a memory of words.

    Such a tokenizer never joins what ASCII white space divides, nor an ASCII letter or digit
    with an ASCII mark (the apostrophe apart), so a text's ids are those of the parts between
    in turn; each distinct part is encoded once and remembered. Texts with combining
    characters or that may hold a special token's string are cut at white space alone and
    keep their capitals.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.spelling = ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts = np.zeros(1 << 16, np.int32)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each part."""
        texts = b"\n".join(parts).decode().split("\n")
        one_word, spelt = self.tokenizer.model.tokenize, self.spelling.pre_tokenize_str
        ids: list[list[int]] = [[]] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            # a word of small letters that no normal form changes is one piece for the model
            if t.isalpha() and t.islower() and t == t.lower() and is_normalized("NFC", t):
                ids[i] = [x.id for x in one_word(t if t.isascii() else spelt(t)[0][0])]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _learn(self, parts: list[bytes]) -> None:
        ids, counts = self._encoded(parts)
        ends = self.used + np.cumsum(counts)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        n = len(self.known)
        while n + len(parts) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : ends[-1]] = ids
        self.starts[n + 1 : n + 1 + len(parts)] = ends
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.used = int(ends[-1])

    def _parts(self, raw: np.ndarray, offsets: np.ndarray, plain: bool) -> tuple[pa.Array, np.ndarray]:
        """Parts of the rows' bytes in turn and each row's offset into them."""
        texts, heads, done = [], [], 0
        for a in range(0, len(raw), 1 << 17):  # so few at a time that they stay in the processor's cache
            kind = _KIND[raw[max(0, a - 1) : a + (1 << 17)]]
            before = np.concatenate([[np.int8(3)], kind[:-1]])
            if a:
                kind, before = kind[1:], before[1:]
            inner = kind != 3
            head = before == 3
            if plain:
                head |= (kind ^ before) == 3  # 1 beside 2
            head &= inner
            first = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(kind))] - a
            head[first] = inner[first]
            texts.append(raw[a : a + len(kind)][inner])
            heads.append(np.flatnonzero(head[inner]) + done)
            done += len(texts[-1])
        text = np.concatenate(texts) if texts else raw
        starts = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        bounds = np.append(starts, len(text)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(_LOWER[text] if plain else text))])
        # a row's parts begin where the bytes before it that are no white space end
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(_KIND[raw] != 3, np.minimum(offsets[:-1], len(raw) - 1)) * (np.diff(offsets) > 0))]) if len(raw) else np.zeros(len(offsets), np.int64)
        return parts, np.searchsorted(starts, before)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null as empty) and each text's offset."""
        odd = pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{M}|<\|").to_numpy(zero_copy_only=False)
        runs = [0, *(np.flatnonzero(np.diff(odd)) + 1).tolist(), len(texts)]
        got = [self._parts(*utf8(texts.slice(a, b - a)), not odd[a]) for a, b in zip(runs[:-1], runs[1:], strict=True) if b > a]
        if not got:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        words = pa.concat_arrays([g[0] for g in got]).dictionary_encode()
        rows = np.concatenate([[0], *[g[1][1:] + sum(len(h[0]) for h in got[:i]) for i, g in enumerate(got)]])
        if len(self.known) + len(words.dictionary) > self.most:
            self.clear()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if (number < 0).any():
            self._learn([distinct[i] for i in np.flatnonzero(number < 0).tolist()])
            number = np.fromiter(map(self.known.get, distinct), np.int64, len(distinct))
        number = number[words.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        length = self.starts[number + 1] - self.starts[number]
        ends = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(ends[-1], np.uint32)
        for a in range(0, len(number), 1 << 16):  # so few at a time that they stay in the processor's cache
            b = min(a + (1 << 16), len(number))
            shift = (self.starts[number[a:b]] - (ends[a:b] - ends[a])).astype(np.int32)
            place = np.arange(ends[b] - ends[a], dtype=np.int32) + np.repeat(shift, length[a:b])
            out[ends[a] : ends[b]] = self.ids[place]
        return out, ends[rows]


class Levels:
    """Open windows by fill level, and the rule that picks one."""

    def __init__(self, window: int) -> None:
        self.window, self.count = window, np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window number, offset) for a piece of ``size`` tokens, fewer than the window holds."""
        count, room = self.count, self.window - size
        # change of the sum of squares by moving a window from level h to h + size
        change = 2 * (count[size : self.window + 1] - count[: room + 1]) + 2
        change[0] = 2 * count[size] + 1  # a new window leaves no level
        change[room] = 1 - 2 * count[room] if room else change[0]  # a full window joins no level
        change[1:][count[1 : room + 1] == 0] = np.iinfo(np.int64).max
        level = room - int(np.argmin(change[::-1]))  # of equals the fullest
        if level:
            number = self.open[level].pop()
            count[level] -= 1
        else:
            number, self.made = self.made, self.made + 1
        if level + size < self.window:
            self.open[level + size].append(number)
            count[level + size] += 1
        return number, level

    def whole(self) -> int:
        self.made += 1
        return self.made - 1


def _packed(batches: Batches, tokenizer: str, window: int, end_id: int | None) -> Batches:
    tokens, levels = Tokenised(tokenizer), Levels(window)
    block = TaskContext.get().partitionId() << 40
    for batch in slices(batches, "text", 1 << 20):
        ids, ends = tokens.encode(batch.column(1))
        counts = np.diff(ends)
        if end_id is not None:
            ids = np.insert(ids, ends[1:], np.uint32(end_id))
            counts = counts + 1
        ends = np.concatenate([[0], np.cumsum(counts)])
        rows = []
        for k, n in enumerate(counts.tolist()):
            for start in range(0, n, window):
                size = min(window, n - start)
                number, offset = (levels.whole(), 0) if size == window else levels.place(size)
                rows.append((k, start, size, n, block + number, offset))
        row, start, size, total, sequence, offset = np.array(rows, np.int64).reshape(-1, 6).T
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)  # pieces follow the ids
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(row)), "start": start, "length": size, "ids": pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view(np.int32))), "doc_tokens": total, "sequence_id": sequence, "offset": offset})


def packed_sequences(docs: DataFrame, *, tokenizer: str, window: int = 2048, end_id: int | None = 1, block_docs: int = 8192, most_blocks: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns a row for each piece: (id, start, length, ids, doc_tokens, sequence_id, offset).
    ``ids`` are the piece's token ids, ``start`` the ids of its document before it; pieces
    of one sequence follow each other from offset 0 without gaps. ``tokenizer`` is the path
    of a tokenizer file that every executor has. ``end_id`` closes each document (None: no
    closing id; then a document without ids has no piece). Null texts are empty; rows that
    repeat an id, or have none, are documents of their own. An empty table has no rows. There
    is a block for each ``block_docs`` documents, ``most_blocks`` at most; beyond that blocks grow.
    Rows are dealt by id and text, so rows without an id spread over all blocks too; rows that
    repeat both share a block. Columns other than these two are not read.
    """
    blocks = max(1, min(most_blocks, -(-docs.count() // block_docs)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # by id within a block: a task that runs again packs alike
    dealt = rows.repartition(blocks, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text")
    out = dealt.mapInArrow(partial(_packed, tokenizer=tokenizer, window=window, end_id=end_id), "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


def with_crc(pieces: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned crc32 of the ids as little-endian unsigned 32-bit numbers."""
    import zlib

    names = [c for c in pieces.columns if c != "ids"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ends = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            kept = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            yield pa.RecordBatch.from_pydict(kept | {"ids_crc32": pa.array(crc, pa.int64())})

    kinds = dict(pieces.dtypes)
    return pieces.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", ids_crc32 long")
