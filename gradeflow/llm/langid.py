"""Language identification by nearest centroid (operator 8).

A text is a normalised TF-IDF vector of hashed byte n-grams. Each language has several
centroids, found by spherical k-means in a bounded sample of its texts; document frequencies
come from all training texts. The language of the nearest centroid by cosine wins; a text
farther from it than nearly all of the centroid's own texts is rejected.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, slices, utf8

DIMS = 4096
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
# white space, digits and ASCII marks are all one border; they tell nothing of the language
_LOWER[[*range(65), *range(91, 97), *range(123, 128)]] = 32


def counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of bytes, a row of ``DIMS`` for each text; grams never span texts."""
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)
    b = _LOWER[raw]
    for size in (2, 3):
        if len(b) < size:
            continue
        code = np.zeros(len(b) - size + 1, np.uint32)
        for k in range(size):
            code = code * np.uint32(0x01000193) + b[k : k + len(code)]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        for i, (a, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if e - a >= size:
                out[i] += np.bincount(code[a : e - size + 1], minlength=DIMS)
    return out


def _frequencies(batches: Batches) -> Batches:
    df, rows = np.zeros(DIMS, np.int64), 0
    for batch in slices(batches, "text"):
        df += (counts(batch.column(0)) > 0).sum(0)
        rows += batch.num_rows
    yield pa.RecordBatch.from_pydict({"dim": np.arange(DIMS + 1, dtype=np.int32), "df": np.append(df, rows)})


def _sampled(batches: Batches) -> Batches:
    for batch in slices(batches, "text"):
        c = counts(batch.column(2))
        yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "h": batch.column(1), "v": pa.array([r.tobytes() for r in c], pa.binary())})


class Centroids:
    def __init__(self, df: np.ndarray, rows: int, langs: list[str], vectors: np.ndarray, per_lang: int, reject: float) -> None:
        self.idf = np.log((1 + rows) / (1 + df)).astype(np.float32) + np.float32(0.1)
        x = self.weighted(vectors)
        self.langs, points, self.least = [], [], []
        for lang in sorted(set(langs)):
            own = x[[k for k, v in enumerate(langs) if v == lang]]
            own = own[np.abs(own).sum(1) > 0]
            if not len(own):
                continue
            c = own[np.linspace(0, len(own) - 1, min(per_lang, len(own))).astype(int)]
            for _ in range(10):
                near = (own @ c.T).argmax(1)
                c = np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            sims = own @ c.T
            near = sims.argmax(1)
            for j in range(len(c)):
                if (near == j).any():
                    self.langs.append(lang)
                    points.append(c[j])
                    self.least.append(float(np.quantile(sims[near == j, j], reject)))
        self.points = np.stack(points).astype(np.float32) if points else np.zeros((0, DIMS), np.float32)

    def weighted(self, c: np.ndarray) -> np.ndarray:
        x = np.log1p(c) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine from 0 to 1, rejected. ``und`` for a text that is null or has no letter."""
        sims = self.weighted(counts(texts)) @ self.points.T
        near = sims.argmax(1) if sims.shape[1] else np.full(len(texts), -1)
        best = np.clip(sims.max(1), 0, 1) if sims.shape[1] else np.zeros(len(texts))
        lang, rejected = [], np.zeros(len(texts), bool)
        for i, t in enumerate(texts.to_pylist()):
            letters = t is not None and any(map(str.isalpha, t))
            lang.append(self.langs[near[i]] if letters and near[i] >= 0 else "und")
            rejected[i] = lang[-1] == "und" or best[i] < self.least[near[i]]
            if lang[-1] == "und":
                best[i] = 0
        return lang, best.astype(float), rejected


def fit_languages(docs: DataFrame, train: Column, *, fit_rows: int = 2_000, per_lang: int = 4, reject: float = 0.005, text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Fit on the rows where ``train`` holds and text and language are there.

    Document frequencies are counted over all of them; the centroids come from at most
    ``fit_rows`` distinct texts, of each language the same number with the least hashes. Where there are
    more languages than that, those with the most rows are learned, ties by name, a text of each.
    """
    rows = docs.where(train).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    got = rows.select("text").mapInArrow(_frequencies, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIMS + 1)
    df[got.dim.to_numpy()] = got.df.to_numpy()
    hashed = rows.withColumn("h", F.xxhash64("text"))
    langs = hashed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit_rows).select("lang")
    langs = hashed.sparkSession.createDataFrame(langs.collect(), "lang string")
    each = fit_rows // max(1, langs.count())
    drawn = least_hashes(hashed.select("lang", "h").join(F.broadcast(langs), "lang"), each)
    texts = hashed.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = texts.mapInArrow(_sampled, "lang string, h long, v binary").toPandas().sort_values(["lang", "h"])
    vectors = np.stack([np.frombuffer(v, np.float32) for v in sample.v]) if len(sample) else np.zeros((0, DIMS), np.float32)
    return Centroids(df[:-1], int(df[-1]), sample.lang.tolist(), vectors, per_lang, reject)


def least_hashes(pairs: DataFrame, most: int, parts: int = 64) -> DataFrame:
    """Of distinct (lang, h) the ``most`` least h of each lang; first in parts, so that no task sorts a whole language."""
    some = pairs.distinct().withColumn("_part", F.pmod("h", F.lit(parts)))
    for by in (["lang", "_part"], ["lang"]):
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("_n") <= most).drop("_n")
    return some.select("lang", "h")


def _named(batches: Batches, model: Centroids) -> Batches:
    for batch in slices(batches, "text"):
        lang, score, rejected = model.predict(batch.column(1))
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "lang_pred": lang, "score": score, "rejected": rejected})


def identify(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row. Only the text is read.

    ``lang_pred`` is the nearest language even where ``rejected`` says that it is too far;
    callers that want no answer then take ``und``. Null texts and texts without a letter are
    ``und`` with score 0, and so is every text if nothing was learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(partial(_named, model=model), f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
