"""URL rules as a sort-merge range join (operator 9).

A host's labels in reverse, each with a dot, are its canonical key: a rule's host is a prefix
of the keys of all its subdomains, so a rule is an interval of keys. Pages and rules are dealt
to ranges of the sorted key, a rule to every range that it overlaps; in each range one sweep
in key order keeps a stack of the rules whose intervals hold the current key. Intervals of
prefixes nest or are apart, so the stack is as deep as a host has labels. The sort key ends with
path and id, so a single host with a third of all pages is spread over many ranges.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import Batches


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.b.c`` -> ``c.b.a.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """The rules whose host intervals hold the current key, the widest first."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, key: str, path: str, rule: str, verdict: str) -> None:
        self._leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, rules, lengths = self.stack[-1]
        # of two rules for one host and path a block stands
        if path not in rules or (verdict, rule) > rules[path][::-1]:
            rules[path] = (rule, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule (host and path together) that fits, or none."""
        self._leave(key)
        best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        for depth, (_, rules, lengths) in enumerate(self.stack):
            for n in lengths:
                if n <= len(path) and (hit := rules.get(path[:n])):
                    best = max(best, (len(hit[0]), depth, *hit), key=lambda b: b[:2])
                    break
        return best[2], best[3]


def _deal(batches: Batches, cuts: list[str], rules: bool) -> Batches:
    """Add the number of the range of each row's sort key; a rule comes once for each range it overlaps."""
    edges = np.array(cuts, dtype=object)
    for batch in batches:
        keys = np.array(batch.column(0).to_pylist(), dtype=object)
        low = np.searchsorted(edges, keys, side="right") if len(keys) else np.zeros(0, int)
        if rules:
            # the interval ends before the key whose last dot is the next character
            high = np.searchsorted(edges, np.array([k[:-1] + "/" for k in keys], dtype=object), side="left") if len(keys) else low
            at = np.repeat(np.arange(len(keys)), high - low + 1)
            part = np.arange(len(at)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[at]
            batch = batch.take(pa.array(at))
        else:
            part = low
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])


def _swept(batches: Batches, otherwise: str) -> Batches:
    part, sweep = None, Sweep()
    for batch in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for p, is_page, key, page, host, path, rule, verdict in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("part", "is_page", "key", "page_id", "host", "path", "rule", "verdict")), strict=True):
            if p != part:
                part, sweep = p, Sweep()
            if not is_page:
                sweep.enter(key, path, rule, verdict)
                continue
            found, said = sweep.judge(key, path)
            ids.append(page)
            hosts.append(host)
            paths.append(path)
            rules.append(found)
            verdicts.append(said or otherwise)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("page_id").type), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, *, otherwise: str = "allow", ranges: int | None = None, sample_rows: int = 20_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains where the url's path starts with its path; of the fitting ones the longest
    wins (host and path together; of equals the one for the deeper host). ``rule`` is its host
    and path, null where none fits, and the verdict is then ``otherwise``. A null url or one
    without ``://`` has an empty host and path. Rules with a null part or an empty host fit nothing.
    Repeated pages have a row each. The ranges are cut at a sample of about ``sample_rows`` keys (it
    decides only how even they are, as do the 256 characters of a key that are looked at); all pages and rules are judged.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col).cast("string")
    page = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    page = page.withColumn("key", host_key(F.col("host")))
    page = page.select(F.concat_ws("\x01", "key", "path", F.xxhash64("page_id").cast("string")).alias("sort_key"), F.lit(True).alias("is_page"), "key", "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    rule = rules.where("host is not null and path is not null and verdict is not null and host <> ''").select(F.lower("host").alias("host"), "path", "verdict")
    rule = rule.select(host_key(F.col("host")).alias("sort_key"), F.lit(False).alias("is_page"), host_key(F.col("host")).alias("key"), F.lit(None).cast(page.schema["page_id"].dataType).alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")

    rows = page.count()
    share = min(1.0, sample_rows / max(1, rows))
    # about sample_rows keys, the same on every run
    sampled = sorted(r[0] for r in page.where(F.pmod(F.xxhash64("sort_key"), F.lit(1 << 30)) <= int(share * (1 << 30))).select(F.substring("sort_key", 1, 256)).limit(2 * sample_rows).collect())
    cuts = sorted({sampled[len(sampled) * k // ranges] for k in range(1, ranges)}) if sampled else []
    schema = ", ".join(f"{n} {k}" for n, k in page.dtypes) + ", part int"
    events = page.mapInArrow(partial(_deal, cuts=cuts, rules=False), schema).unionByName(rule.mapInArrow(partial(_deal, cuts=cuts, rules=True), schema))
    ordered = events.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "key", "is_page", "sort_key")
    kind = dict(page.dtypes)["page_id"]
    out = ordered.mapInArrow(partial(_swept, otherwise=otherwise), f"page_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("page_id", id_col)
