"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names, or the checkpoint folder of the session. Only on a
    local master, where all is one machine, a temporary one is set in their absence; on a
    cluster that would lose rows, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gradeflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage that survives lost executors.

    What the write itself shuffled is no longer needed then and goes with the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str) -> Column:
    """crc32 of an id written as text; decides held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice hold about ``most`` bytes (or one row) and it has ``rows`` rows at most."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum([0 if n is None else n for n in pc.binary_length(col).to_pylist()])
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null as empty) and the row offsets into them."""
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = np.random.default_rng(20240117)
#: A random number for each byte; capital A-Z count as small letters.
_OF_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0xD1342543DE82EF95


def _powers(n: int, cache: dict = {"p": np.ones(1, np.uint64)}) -> np.ndarray:  # noqa: B006
    """1, s, s^2, ... modulo 2^64; kept for the process and grown by doubling."""
    p = cache["p"]
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(_STEP, len(p), 2**64))])
    cache["p"] = p
    return p


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) and the rows' word offsets."""
    inner = np.flatnonzero(~_SPACE[raw])
    if not len(inner):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    head = np.empty(len(inner), bool)
    head[0] = True
    head[1:] = np.diff(inner) > 1
    at = np.searchsorted(inner, offsets[:-1])  # a row's first byte begins a word whatever stands before it
    head[at[at < len(inner)]] = True
    starts = np.flatnonzero(head)
    lengths = np.diff(np.append(starts, len(inner)))
    place = np.arange(len(inner)) - np.repeat(starts, lengths)
    values = _OF_BYTE[raw[inner]]
    values *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64)), np.searchsorted(inner[starts], offsets)


_FACTORS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit hashes of each row's distinct shingles of ``words`` words, and the rows' offsets.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    hashes, ends = word_hashes(raw, offsets)
    rolled = np.zeros(len(hashes), np.uint64)
    whole = max(0, len(hashes) - words + 1)
    for k in range(words):
        rolled[:whole] += hashes[k : k + whole] * _FACTORS[k]
    rolled = mix(rolled, words)
    counts = np.diff(ends)
    keep = np.arange(len(hashes)) < np.repeat(ends[1:] - words + 1, counts)
    for k in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        a, b = ends[k], ends[k + 1]
        keep[a] = True
        rolled[a] = mix((hashes[a:b] * _FACTORS[: b - a]).sum(keepdims=True), 1000 + int(b - a))[0]
    at = np.concatenate([[0], np.cumsum(keep)])[ends]
    rolled = rolled[keep]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        rolled[a:b].sort()
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = rolled[1:] != rolled[:-1]
    fresh[at[:-1][at[:-1] < len(rolled)]] = True
    return rolled[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of the values between offsets; 0 where there are none."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    some = np.diff(offsets) > 0
    if some.any():
        out[some] = np.add.reduceat(values, offsets[:-1][some])
    return out


Batches = Iterator[pa.RecordBatch]
Mapper = Callable[[Batches], Batches]
