"""Quality scores by positive-unlabelled learning (operator 6).

Trusted positives and unlabelled web text are described by the shape of the text: kinds of
characters, lengths and repetition of words. The share of good texts among the unlabelled
is estimated from the two samples, and a logistic model minimises the non-negative
unbiased risk: the positives' loss as positives, weighted by that share, plus the
unlabelled texts' loss as negatives less what the positives among them account for, the
latter kept from falling below zero.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, id_crc, row_sums, slices, utf8, word_hashes

_CLASS = np.zeros(256, np.int8)  # 0 other marks, 1 small letters, 2 capitals, 3 digits, 4 white space, 5 usual marks, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
KINDS = 7
FEATURES = 2 * 17 + 1


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text; null and empty texts have zeros but for the last (1)."""
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = np.zeros((n, KINDS))
    for k in range(KINDS):
        kinds[:, k] = row_sums((_CLASS[raw] == k).astype(np.uint64), offsets)
    share = kinds / np.maximum(size, 1)[:, None]
    words, at = word_hashes(raw, offsets)
    count = np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    same = np.zeros((n, 2))
    for gap in (1, 2):
        if len(words) > gap:
            hit = (words[gap:] == words[:-gap]) & (owner[gap:] == owner[:-gap])
            same[:, gap - 1] = np.bincount(owner[gap:][hit], minlength=n)
    order = np.lexsort((words, owner))
    head = np.ones(len(words), bool)
    head[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][head], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(head), len(words)))
    top = np.zeros(n)
    np.maximum.at(top, owner[order][head], runs)
    pairs = words[1:] * np.uint64(3) + words[:-1] if len(words) > 1 else words[:0]
    pair_owner = owner[1:][owner[1:] == owner[:-1]] if len(words) > 1 else owner[:0]
    pairs = pairs[owner[1:] == owner[:-1]] if len(words) > 1 else pairs
    porder = np.lexsort((pairs, pair_owner))
    phead = np.ones(len(pairs), bool)
    phead[1:] = (pairs[porder][1:] != pairs[porder][:-1]) | (pair_owner[porder][1:] != pair_owner[porder][:-1])
    distinct_pairs = np.bincount(pair_owner[porder][phead], minlength=n)
    some = np.maximum(count, 1)
    base = np.column_stack([
        share,
        share[:, 2] / np.maximum(share[:, 1] + share[:, 2], 1e-9),
        np.log1p(size), np.log1p(count), size / some / 10, same / some[:, None],
        1 - distinct / some, top / some, 1 - distinct_pairs / np.maximum(count - 1, 1) * (count > 1),
        kinds[:, 0] / some,
    ])
    base[size == 0] = 0
    return np.column_stack([base, base * base, np.ones(n)]).astype(np.float64)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, decay: float) -> np.ndarray:
    """Weights of a logistic model: for P against U where ``prior`` is None, else by non-negative risk."""
    w = np.zeros(positive.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p, u = _logistic(positive @ w), _logistic(unlabelled @ w)
        as_negative_p, as_negative_u = positive.T @ p / len(p), unlabelled.T @ u / len(u)
        as_positive = positive.T @ (p - 1) / len(p)
        if prior is None:
            g = as_positive + as_negative_u
        else:
            rest = -np.log(np.maximum(1 - u, 1e-12)).mean() - prior * -np.log(np.maximum(1 - p, 1e-12)).mean()
            rest_g = as_negative_u - prior * as_negative_p
            # a negative part below zero is overfitting: step back from it
            g = prior * as_positive + rest_g if rest >= 0 else -0.5 * rest_g
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: no region holds relatively fewer unlabelled than that.

    The regions are those above a threshold of a model that tells the two samples apart and
    that hold a fifth of the positives at least, with a margin for chance.
    """
    w = _fit(positive, unlabelled, None, 300, 1e-3)
    p, u = positive @ w, unlabelled @ w
    cuts = np.quantile(p, np.linspace(0, 0.8, 33))
    above_p = np.array([(p >= c).mean() for c in cuts])
    above_u = np.array([(u >= c).mean() for c in cuts])
    margin = np.sqrt(1 / max(1, len(p)) + 1 / max(1, len(u)))
    return float(np.clip(((above_u + margin) / above_p).min(), 0.05, 0.95))


class PUModel:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        both = np.concatenate([positive, unlabelled])
        self.mean, self.spread = both.mean(0), both.std(0)
        self.mean[-1], self.spread[self.spread < 1e-9] = 0, 1
        positive, unlabelled = (self._scaled(x) for x in (positive, unlabelled))
        self.prior = class_prior(positive, unlabelled)
        self.weights = _fit(positive, unlabelled, self.prior, 600, 1e-4)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._scaled(x) @ self.weights)


def _described(batches: Batches) -> Batches:
    for batch in slices(batches, "text"):
        x = features(batch.column(1))
        yield pa.RecordBatch.from_pydict({"positive": batch.column(0), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))})


def fit_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 10_000, held_out: int | None = 5) -> PUModel | None:
    """Fit on at most ``fit_rows`` trusted positives and as many unlabelled documents.

    Rows whose crc32 of the id modulo ``held_out`` is 0 are never used (None: all may be).
    Samples are the rows of least hash, so they do not depend on the order or the dealing of
    rows. None without positives.
    """
    may = (id_crc("doc_id") % held_out != 0) if held_out else F.lit(True)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    trusted = labels.where("quality = 1 and doc_id is not null").where(may).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    others = docs.where("doc_id is not null").where(may).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(fit_rows)
    # 16 bytes for each of so many rows: bounded by the parameter
    chosen = trusted.withColumn("positive", F.lit(1)).unionByName(others.withColumn("positive", F.lit(0)))
    # an id that repeats adds one text: of its rows that of least hash
    first = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(first.alias("text")).select("positive", "text")
    got = rows.mapInArrow(_described, "positive int, x array<double>").toPandas()
    x = np.stack(got.x.to_numpy()) if len(got) else np.zeros((0, FEATURES))
    positive, unlabelled = x[got.positive.to_numpy() == 1], x[got.positive.to_numpy() == 0]
    return PUModel(positive, unlabelled) if len(positive) and len(unlabelled) else None


def _scores(batches: Batches, model: PUModel | None, text: str) -> Batches:
    for batch in slices(batches, text):
        i = batch.schema.get_field_index(text)
        score = model.score(features(batch.column(i))) if model else np.ones(batch.num_rows)
        columns = {n: batch.column(j) for j, n in enumerate(batch.schema.names)}
        yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score)})


def _judged(docs: DataFrame, model: PUModel | None, text_col: str) -> DataFrame:
    """``docs`` with columns named by their places, c0 and so on, and ``score``."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = ", ".join([*(f"{n} {k}" for n, k in plain.dtypes), "score double"])
    return plain.mapInArrow(partial(_scores, model=model, text=f"c{names.index(text_col)}"), schema)


def with_quality(docs: DataFrame, model: PUModel | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for good text. Null and empty texts get the score of an empty text.

    Without a model (no trusted positives) nothing is held against a text: 1. Columns may have
    any names; a caller's column named ``score_col`` stays beside the new one.
    """
    return _judged(docs, model, text_col).toDF(*docs.columns, score_col)


def good_documents(docs: DataFrame, model: PUModel | None, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, columns as they were, whatever their names."""
    return _judged(docs, model, text_col).where(F.col("score") >= least).drop("score").toDF(*docs.columns)
