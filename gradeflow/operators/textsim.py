"""Similarity of answers to references."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gradeflow.functions.columns import match_key, squeezed

# What ends a sentence, marks around a token, numbers and codes that count as conditions.
SENTENCE_ENDS = "\n\r.!?。！？;；"
TOKEN_MARKS = " \t\r\n\"'`.,;:!?()[]{}<>"
_UNITS = "(?:원|만원|억원|%|퍼센트|개월|년|일|회|번|점|시간|분|초|영업일)"
NUMBER_PATTERNS = (
    r"\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}\s*일?",
    r"\d{1,2}\s*[:시]\s*\d{2}\s*분?",
    r"\d{2,4}\s*[- ]\s*\d{3,4}\s*[- ]\s*\d{4}",
    rf"\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?\s*{_UNITS}?",
    rf"\d+(?:\.\d+)?\s*{_UNITS}",
    r"[A-Z]{2,}[-_]?\d{2,}[A-Z0-9_-]*",
    r"\b\d{4,}\b",
)
EXACT_LENGTH, SIMILAR = 6, 55.0


def tokens(c: Column) -> Column:
    """Distinct tokens between white space."""
    return F.array_distinct(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))


def sentences(c: Column) -> Column:
    """The parts of a text between sentence ends; the whole text where it has none."""
    parts = F.filter(F.transform(F.split(squeezed(c), f"[{re.escape(SENTENCE_ENDS)}]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.array(squeezed(c)), lambda x: x != ""))


class Grams:
    """Counts of the character n-grams of several texts without white space, in lower case.

    The characters of the texts are numbered, so that a gram and the place of its text make one whole number, and one sort
    of these numbers brings equal grams together. ``counted`` is None where they pass 64 bits, as with very many kinds of characters.
    """

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.number = np.zeros(int(code.max(initial=0)) + 1, np.uint64)  # of each character, 0: in none of the texts
        self.number[code] = 1
        self.alphabet = np.flatnonzero(self.number)
        self.number[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.ids = self.number[code]
        self.bits, self.low = len(self.alphabet).bit_length(), (len(texts) - 1).bit_length()
        self.owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])
        self.mask = (1 << self.low) - 1
        self.known: dict[int, tuple | None] = {}

    def counted(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The distinct keys (gram, then place of the text), how often each occurs, and the norm of each text."""
        if n not in self.known:
            self.known[n] = self._counted(n) if n * self.bits + self.low <= 64 else None
        return self.known[n]

    def _counted(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = max(0, len(self.ids) - n + 1)
        key = self.ids[:size]
        for k in range(1, n):
            key = key << self.bits | self.ids[k : k + size]
        if self.low:
            inside = self.owner[n - 1 :] == self.owner[:size]
            key = (key << self.low | self.owner[:size])[inside]
        if n * self.bits + self.low <= 32:
            key = key.astype(np.uint32)
        key = np.sort(key)
        head = np.flatnonzero(np.concatenate([[len(key) > 0], key[1:] != key[:-1]]))
        count, key = np.diff(np.append(head, len(key))).astype(float), key[head].astype(np.uint64)
        return key, count, np.sqrt(np.bincount((key & self.mask).astype(int), count**2, len(self.texts)))

    def norm(self, n: int) -> float:
        """The norm of the first text."""
        found = self.counted(n)
        return float(found[2][0]) if found else math.sqrt(sum(m * m for m in self.plain(n)[0].values()))

    def plain(self, n: int) -> list[Counter]:
        return [Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in self.texts]

    def nearest(self, reference: "Reference", n: int) -> float:
        """The largest cosine of any of these texts with the reference, which has n characters at least."""
        if (found := self.counted(n)) is None:
            wanted = Grams([reference.text]).plain(n)[0]
            dots = [(sum(m * t[g] for g, m in wanted.items()), t) for t in self.plain(n)]
            return max((dot / (math.sqrt(sum(m * m for m in t.values())) * reference.norm(n)) for dot, t in dots if dot), default=0.0)
        key, count, norm = found
        ids = self.number[np.where(reference.code < len(self.number), reference.code, 0)]
        ids[reference.code >= len(self.number)] = 0
        size = len(ids) - n + 1
        gram, known = ids[:size], ids[:size] > 0
        for k in range(1, n):
            gram, known = gram << self.bits | ids[k : k + size], known & (ids[k : k + size] > 0)
        # a gram that the reference has twice is looked up twice, so its own counts are not needed
        gram = gram[known] << self.low
        first = np.searchsorted(key, gram)
        if not self.low:
            first = np.minimum(first, len(key) - 1) if len(key) else first[:0]
            dot = count[first[key[first] == gram[: len(first)]]].sum()
            return float(dot / (norm[0] * reference.norm(n))) if dot else 0.0
        span = np.searchsorted(key, gram | self.mask, "right") - first
        at = np.repeat(first - np.cumsum(span) + span, span) + np.arange(span.sum())
        dot = np.bincount((key[at] & self.mask).astype(int), count[at], len(norm))
        some = dot > 0
        return float((dot[some] / (norm[some] * reference.norm(n))).max(initial=0.0))


class Reference:
    """A text without white space, in lower case, made ready to be compared with many others."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.norms: dict[int, float] = {}

    def norm(self, n: int) -> float:
        if n not in self.norms:
            own = Grams([self.text])
            self.norms |= {k: own.norm(k) for k in (2, 3, 4)}
        return self.norms[n]


def terms_of(text: str) -> frozenset[str]:
    return frozenset(t for w in set(text.split()) if len(t := w.strip(TOKEN_MARKS).lower()) > 1)


#: Passages come again and again as references of many answers; a worker keeps so many of them, but no long ones.
KEPT = 2000
_kept_reference, _kept_terms = lru_cache(4096)(Reference), lru_cache(4096)(terms_of)


def as_reference(text: str) -> Reference:
    return _kept_reference(text) if len(text) <= KEPT else Reference(text)


def gram_similarity(reference: str, texts: Grams, short: set[str]) -> float:
    """The largest cosine over n = 2, 3, 4 and over the texts, given as compact strings; a text shorter than n is one gram."""
    best, told = 0.0, as_reference(reference)
    for n in (2, 3, 4):
        if len(reference) < n:
            best = max(best, float(bool(reference) and reference in short))
        elif texts.texts:
            best = max(best, texts.nearest(told, n))
    return best


def gram_cosine_of(a: str, b: str) -> float:
    """The largest cosine over n = 2, 3, 4 of two compact texts that are not empty: both are counted by one sort for each n."""
    both, best = Grams([a, b]), 0.0
    for n in (2, 3, 4):
        found = both.counted(n)
        if min(len(a), len(b)) < n or found is None:
            best = max(best, float(a == b) if min(len(a), len(b)) < n else Grams([b]).nearest(Reference(a), n))
            continue
        key, count, norm = found
        # a gram of both texts stands twice in a row, first for the one, then for the other
        at = np.flatnonzero((key[1:] ^ key[:-1]) == 1)
        at = at[key[at] & 1 == 0]
        dot = float(count[at] @ count[at + 1])
        best = max(best, dot / (norm[0] * norm[1]) if dot else 0.0)
    return best


class Answer:
    """An answer made ready to be compared with many references."""

    def __init__(self, text: str | None) -> None:
        self.text = " ".join((text or "").split())
        parts = [x for p in re.split(f"[{re.escape(SENTENCE_ENDS)}]+", self.text) if (x := p.strip())]
        self.parts = list(dict.fromkeys([self.text, *parts])) if self.text else []
        self.compact = list(dict.fromkeys("".join(p.lower().split()) for p in self.parts))
        self.tokens = [set(p.split()) for p in self.parts]
        self.grams: Grams | None = None
        self.terms: frozenset[str] | None = None
        self.known: dict[str, float] = {}

    def similarity(self, reference: str) -> float:
        """1 if the reference is contained, else the best of token overlap and gram cosine over the answer and its sentences."""
        key = "".join(reference.lower().split())
        if not key or not self.text:
            return 0.0
        if key in self.compact[0]:
            return 1.0
        if self.grams is None:
            self.grams, self.short = Grams(self.compact), set(self.compact)
        if reference not in self.known:
            self.known[reference] = min(1.0, max(self.overlap(reference), gram_similarity(key, self.grams, self.compact)))
        return self.known[reference]

    def overlap(self, reference: str, whole: bool = False) -> float:
        wanted = {t for t in reference.split() if len(t) > 1}
        return max((len(wanted & t) for t in (self.tokens[:1] if whole else self.tokens)), default=0) / len(wanted) if wanted else 0.0

    def evidence(self, reference: str) -> float:
        """Percent; a few copied keywords of a long reference are no grounding (T5)."""
        key = "".join(reference.lower().split())
        if not key or not self.text:
            return 0.0
        if key in self.compact[0]:
            return 100.0
        lexical = round(100 * self.overlap(reference, whole=True), 2)
        if self.terms is None:
            self.terms = terms_of(self.text)
        terms = _kept_terms(reference) if len(reference) <= KEPT else terms_of(reference)
        length, cover = min(1.0, len(self.compact[0]) / len(key)), len(terms & self.terms) / len(terms) if terms else 0.0
        if len(key) > 40 and length <= 0.32 and cover < 0.35:
            return round(min(19.0, lexical + 5), 2)
        similar = round(100 * self.similarity(reference), 2)
        return round(max(lexical, min(similar, 35.0) if len(key) > 40 and length < 0.45 and cover < 0.45 else similar), 2)


SIMILARITIES = ArrayType(StructType([StructField(n, DoubleType()) for n in ("overlap", "similarity", "evidence")]))


def with_similarities(rows: DataFrame, answer: str, references: str, name: str) -> DataFrame:
    """``rows`` with ``name``: an array of overlap, similarity and evidence similarity in percent of an answer with each of an array of references.

    All of a row's comparisons happen in its task: no gram leaves it. Null and blank texts are similar to nothing.
    """
    kind = pa.list_(pa.struct([(n, pa.float64()) for n in ("overlap", "similarity", "evidence")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (answer, references))
            out = []
            for text, refs in zip(texts, wanted, strict=True):
                own = Answer(text)
                told = [" ".join((r or "").split()) for r in refs or ()]
                # a row often names a reference several times, as gold answer, condition and evidence
                each = {r: {"overlap": round(100 * own.overlap(r, whole=True), 2), "similarity": round(100 * own.similarity(r), 2), "evidence": own.evidence(r)} for r in dict.fromkeys(told)}
                out.append([each[r] for r in told])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, SIMILARITIES)]))


def _gram_cosines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        out = []
        for pair in zip(left, right, strict=True):
            a, b = ("".join((t or "").lower().split()) for t in pair)
            out.append(gram_cosine_of(a, b) if a and b else 0.0)
        yield pd.Series(out, dtype=float)


def gram_cosine(reference: Column, answer: Column) -> Column:
    """Cosine of character n-gram counts of two texts, the largest over n = 2, 3, 4 (T2), row by row."""
    return F.pandas_udf(_gram_cosines, "double")(reference, answer)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is null, zero or of another length (T4, 2.8)."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b))), F.lit(0.0))).otherwise(0.0)


def numbers(c: Column) -> Column:
    """Distinct numbers, dates, amounts and codes in a text, pattern by pattern."""
    text = squeezed(F.coalesce(c, F.lit("")))
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(0)) for p in NUMBER_PATTERNS]))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"^[ ,.;:()\[\]{}<>]+|[ ,.;:()\[\]{}<>]+$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def contains_condition(answer: Column, condition: Column, key: Column | None = None) -> Column:
    """Whether an answer holds a condition, as it stands or white space and case aside; a blank one it does not.

    ``key`` is the answer's ``match_key`` as a column of its own: in a lambda over conditions it would be made anew for each of them.
    """
    c = F.trim(condition)
    key = match_key(F.coalesce(answer, F.lit(""))) if key is None else key
    return (c != "") & (F.coalesce(answer, F.lit("")).contains(c) | key.contains(match_key(c)))


def wants_exact(condition: Column) -> Column:
    """Conditions that similarity can't meet: up to six characters, or with a number or code in them."""
    return (F.length(match_key(condition)) <= EXACT_LENGTH) | (F.size(numbers(condition)) > 0)


def condition_hits(answer: Column, required: Column, scores: Column, least: float = SIMILAR, key: Column | None = None) -> Column:
    """The required conditions that an answer meets (T7); ``scores`` are the similarities of the answer with them."""
    met = F.zip_with(required, scores, lambda c, s: F.struct(c.alias("c"), (contains_condition(answer, c, key) | (~wants_exact(c) & (s["similarity"] >= least))).alias("hit")))
    return F.transform(F.filter(met, lambda x: x["hit"]), lambda x: x["c"])


def numeric_accuracy(gold: Column, required: Column, hits: Column, answer: Column, question_type: Column, numeric_type: str, marks: tuple[str, ...], key: Column | None = None) -> Column:
    """Percent of the numbers and codes asked for that an answer has (T8); 100 where none is asked, but 0 for a numeric case without an answer."""
    digits = lambda xs: F.filter(xs, lambda x: x.rlike(r"(?U)\d"))
    asked = F.array_distinct(F.concat(numbers(gold), digits(required)))
    kind = F.coalesce(question_type, F.lit(""))
    numeric = kind == numeric_type
    for m in marks:
        numeric = numeric | F.lower(kind).contains(m)
    found = F.size(F.filter(asked, lambda c: contains_condition(answer, c, key)))
    got = F.when((found == 0) & (F.size(hits) > 0), F.size(digits(hits))).otherwise(found)
    none = F.when(numeric & (F.coalesce(answer, F.lit("")) == ""), 0.0).otherwise(100.0)
    return F.when(F.size(asked) == 0, none).otherwise(F.bround(F.try_divide(F.lit(100.0) * got, F.size(asked)), 2))
