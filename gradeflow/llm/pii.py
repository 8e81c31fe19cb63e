"""Personal data in texts (operator 5).

Regular expressions propose spans, checksums (Luhn, mod-97) and number rules confirm them,
and words near a span raise or lower its score. A run of letters and digits is a secret (a key,
a token) only where words near it say so. All patterns run in time linear in the
text: none may start inside a run it has already rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches, slices

#: Kinds in the order in which spans are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number that begins inside a run of digits would have been met at the run's start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_WORD = re.compile(r"[^\W\d_]+")

#: Characters of an IBAN by country.
IBAN_LENGTH = {c: int(n) for n, cs in (
    ("15", "NO"), ("16", "BE"), ("18", "DK FI FK FO GL NL SD"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU MN XK"), ("21", "CH HR LI LV"),
    ("22", "BG BH CR DE GB GE IE ME RS VA"), ("23", "AE GI IL IQ OM SO TL"), ("24", "AD CZ ES MD PK RO SA SE SK TN VG"), ("25", "LY PT ST"), ("26", "IS TR"),
    ("27", "BI DJ FR GR IT MC MR SM"), ("28", "AL AZ BY CY DO GT HN HU LB NI PL SV"), ("29", "BR EG PS QA UA"), ("30", "JO KW MU YE"), ("31", "MT SC"), ("32", "LC"), ("33", "RU"),
) for c in cs.split()}

#: Score of a span before its context is read, and what words near it say.
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.4}
FOR = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "address", "host", "server", "login", "from"},
    "card": {"card", "visa", "credit", "payment", "pay", "account"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "contact"},
    "iban": {"iban", "bank", "account", "transfer", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "secret": {"token", "secret", "key", "apikey", "api", "password", "passwd", "bearer", "credential", "credentials", "auth"},
}
AGAINST = {
    "email": {"example", "sample"},
    "ip": {"version", "release", "section"},
    "card": {"order", "tracking", "serial", "isbn"},
    "phone": {"order", "serial", "part"},
    "iban": {"serial", "model", "part"},
    "ssn": {"part", "order", "serial", "model"},
    "secret": {"checksum", "commit", "digest", "sha", "md"},
}
REACH = 40  # code points read on each side


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits to the end, letters as 10 to 35: the number leaves 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def random_looking(run: str) -> bool:
    """Letters and digits in so many kinds, of 512 characters at most, that a run is no word, number or line of marks."""
    if len(run) > 512 or not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
        return False
    counts = Counter(run)
    return -sum(n / len(run) * log2(n / len(run)) for n in counts.values()) >= 3.0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; found at each @ so that long runs without one cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ibans(text: str, at: int) -> list[tuple[int, int]]:
    """Spans that pass mod-97, left to right, from ``at`` on.

    Capitals or numbers may follow a number, so several ends are tried: the length of the
    country, then the last end; where no length is known, all ends, the last one first.
    """
    out = []
    while m := _IBAN.search(text, at):
        a, run = m.start(), m[0]
        following = text[m.end() : m.end() + 1]
        ends = [k for k in range(len(run), 14, -1) if run[k - 1] != " " and not ((run[k : k + 1] or following).isascii() and (run[k : k + 1] or following).isalnum())]
        sizes = {k: k - run.count(" ", 0, k) for k in ends}
        ends = [k for k in ends if 15 <= sizes[k] <= 34]
        if length := IBAN_LENGTH.get(run[:2]):
            ends = [k for k in ends if sizes[k] == length] + ends[:1]
        found = next((k for k in ends if mod97(run[:k].replace(" ", ""))), None)
        if found:
            out.append((a, a + found))
        at = a + (found or 4)
    return out


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end), kind by kind, before the context is read."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    digits = re.search("[0-9]", text)
    if digits:
        at = digits.start()
        out += [("ip", *m.span()) for m in _IP.finditer(text, at) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text, at):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        out += [("iban", *span) for span in ibans(text, max(0, at - 2))]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text, at) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
        out += [("secret", *m.span()) for m in _SECRET.finditer(text) if random_looking(m[0])]
    return out


def scored(text: str, keep: float) -> list[tuple[str, int, int, float]]:
    """Spans with scores. A span that is no base kind needs a score of ``keep``; base spans stay."""
    out = []
    for kind, a, b in proposed(text):
        near = {w.lower() for w in _WORD.findall(text[max(0, a - REACH) : a] + " " + text[b : b + REACH])}
        score = START[kind] + 0.3 * bool(near & FOR[kind]) - 0.3 * bool(near & AGAINST[kind])
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= keep:
            out.append((kind, a, b, score))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])


def _found(batches: Batches, text: str, redact: bool, keep: float) -> Batches:
    for batch in slices(batches, text):
        i = batch.schema.get_field_index(text)
        texts = batch.column(i).to_pylist()
        spans = [scored(t, keep) if t else [] for t in texts]
        columns = {n: batch.column(j) for j, n in enumerate(batch.schema.names)}
        if redact:
            columns[text] = pa.array([t if not s else masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
        else:
            columns["spans"] = pa.array([[{"kind": k, "start": a, "end": b, "score": p, "text": t[a:b]} for k, a, b, p in s] for t, s in zip(texts, spans, strict=True)], pa.list_(_SPAN))
        yield pa.RecordBatch.from_pydict(columns)


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, end = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find_pii(docs: DataFrame, *, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), keep: float = 0.6) -> DataFrame:
    """``id_cols`` and spans array<struct<kind, start, end, score, text>> for each row.

    Start and end are code points, end exclusive; spans come kind by kind (``KINDS``), then by
    start. Kinds beyond the base need a score of ``keep``. Null and empty texts have none. Rows
    that repeat an id are rows of their own, and other columns play no part. Each whole text is read once.
    """
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(id_cols)], F.col(text_col).cast("string").alias("_text"))
    kinds = dict(rows.dtypes)
    schema = "".join(f"`_{i}` {kinds[f'_{i}']}, " for i in range(len(id_cols))) + "_text string, spans array<struct<kind string, start long, end long, score double, text string>>"
    found = rows.mapInArrow(partial(_found, text="_text", redact=False, keep=keep), schema)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(id_cols)], "spans")


def redact_pii(docs: DataFrame, *, text_col: str = "text", keep: float = 0.6) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns and rows as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = f"_{names.index(text_col)}"
    return plain.withColumn(text, F.col(text).cast("string")).mapInArrow(partial(_found, text=text, redact=True, keep=keep), plain.withColumn(text, F.col(text).cast("string")).schema).toDF(*names)
