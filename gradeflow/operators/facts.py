"""Wide facts, attached verdicts, and reuse of earlier answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.columns import blank_to_null, content_hash, squeezed

KEY = ["config_id", "case_id"]


def dense(cases: DataFrame, configs: DataFrame, outputs: DataFrame, scores: DataFrame) -> DataFrame:
    """Every case for every model, answered or not (J2, P24). ``configs`` is a registry of a few rows."""
    grid = cases.crossJoin(configs)
    return grid.join(outputs, KEY, "left").join(scores, KEY, "left")


def sparse(outputs: DataFrame, cases: DataFrame, configs: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each answer, with what is known of its case, model and score."""
    return outputs.join(cases, "case_id", "left").join(configs, "config_id", "left").join(scores, KEY, "left")


def with_verdicts(outputs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Answers with their judges' verdicts as an array in judging order; empty where there are none."""
    kept = verdicts.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "judge_id", "overall", "pass", "error_type"))).alias("verdicts"))
    return outputs.join(kept, KEY, "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast(kept.schema["verdicts"].dataType)))


def flattened(attached: DataFrame) -> DataFrame:
    """A row for each verdict again."""
    return attached.select(*KEY, F.explode("verdicts").alias("v")).select(*KEY, "v.*")


def excerpt(c: Column, most: int = 500) -> Column:
    """The first characters of a text with single spaces (P25)."""
    return F.substring(squeezed(c), 1, most)


def compact(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Texts cut to their limits, cut ones ending in dots."""
    return df.withColumns({c: F.when(F.length(c) > n, F.concat(F.substring(F.col(c), 1, n), F.lit("..."))).otherwise(F.col(c)) for c, n in limits.items()})


def cache_slug(c: Column, most: int = 80) -> Column:
    """A text as a folder name."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.substring(F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown")), 1, most)


def cache_key(*parts: Column) -> Column:
    """The hash of what determines an answer or a verdict (P45); absent parts count as empty."""
    return content_hash(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def fingerprint(**parts: Column) -> Column:
    """The hash of named parts as canonical JSON: names sorted, absent values as null (P45). Parts may be lists and structs."""
    whole = F.struct(*[parts[n].alias(n) for n in sorted(parts)])
    return content_hash(F.to_json(whole, {"ignoreNullFields": "false"}))


def output_fingerprint(config_id: Column, case_id: Column, question: Column, prompt: Column) -> Column:
    """What determines an answer: model, case, question and prompt."""
    return fingerprint(config_id=config_id, case_id=case_id, question=question, prompt=prompt)


def answer_cache_key(provider: Column, model: Column, prompt: Column, question: Column) -> Column:
    """What determines an answer whatever the run: provider, model, prompt and question."""
    return fingerprint(provider=provider, model=model, prompt=prompt, question=question)


def judge_cache_key(judge_id: Column, prompt_hash: Column, output_hash: Column, answer: Column) -> Column:
    """What determines a verdict: judge, prompt and the answer that is judged."""
    return fingerprint(judge_id=judge_id, prompt_hash=prompt_hash, output_fingerprint=output_hash, answer=answer)


def score_fingerprint(output_hash: Column, mode: Column, weight: Column, threshold: Column, judges: Column) -> Column:
    """What determines a score: the answer, how it is scored, and by which judges, in any order."""
    return fingerprint(output_fingerprint=output_hash, mode=mode, weight=weight, threshold=threshold, judges=F.array_sort(judges))


def wide_cases(fact: DataFrame, most: int = 700) -> DataFrame:
    """The wide question-case table from a joined fact (P24): identity, labels, lifecycle, answer and excerpt, static, judge and final scores, regression and gate, whichever the fact has."""
    names = ("case_id", "config_id", "qa_category", "question_type", "qa_topic", "question", "gold_answer", "source_title", "source_url", "expected_behavior", "suite", "severity", "priority", "task_type", "dataset_pool_id", "dataset_role", "dataset_version", "source_hash", "case_source", "benchmark_group", "case_status", "gold_verified", "gate_eligible", "release_gate_eligible", "human_review_required", "provider", "model", "status", "latency_ms", "model_answer", "acc", "com", "nac", "hal_pass", "applicable_metrics", "overall", "pass", "critical_fail", "error_type", "reason", "static_overall", "static_pass", "judge_overall", "judge_pass", "judge_status", "judges", "judge_ids", "conflict", "unresolved", "overall_gap", "pass_mismatch", "agreement_status", "baseline_score", "score_delta", "regression_type", "release_gate")
    kept = [F.col(n) for n in names if n in fact.columns]
    if "model_answer" in fact.columns:
        kept.append(excerpt(F.col("model_answer"), most).alias("answer_excerpt"))
    if "hal_pass" in fact.columns:
        kept.append((1 - F.col("hal_pass")).alias("hal_rate"))
    return fact.select(*kept, F.when(F.col("pass"), "Pass").otherwise("Fail").alias("pass_fail"))


def with_fingerprints(rows: DataFrame, known: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with the fingerprints of their answers (J15); one without any fails, or drops out if not ``strict``."""
    if strict and (lost := rows.join(known, KEY, "left_anti").select(*KEY).limit(5).collect()):
        raise ValueError(f"no fingerprint for {[tuple(r) for r in lost]}")
    return rows.join(known.select(*KEY, "output_fingerprint").distinct(), KEY)


def reusable(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted answers found in the cache under their key (J7, J8); only good, non-blank ones count.

    A key stored more than once gives its latest row. Reading a cache partitioned by the shard
    of the key keeps other shards unread.
    """
    good = cache.where((F.col("status") == "ok") & blank_to_null(F.col("model_answer")).isNotNull())
    latest = good.groupBy("cache_key").agg(F.max_by("model_answer", F.struct("seq", "model_answer")).alias("model_answer"))
    return wanted.join(latest, "cache_key")


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """What is still to do: neither its fingerprint nor its cache key is done."""
    rest = wanted.join(done.select("output_fingerprint").distinct(), "output_fingerprint", "left_anti")
    return rest.join(done.select("cache_key").distinct(), "cache_key", "left_anti")


def complete_only(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """Answers of models that answered every case well (F8)."""
    good = outputs.where((F.col("status") == "ok") & blank_to_null(F.col("model_answer")).isNotNull()).join(cases.select("case_id").distinct(), "case_id", "left_semi")
    need = cases.agg(F.count_distinct("case_id").alias("need"))  # one row
    full = good.groupBy("config_id").agg(F.count_distinct("case_id").alias("have")).crossJoin(need).where("have = need")
    return outputs.join(full.select("config_id"), "config_id", "left_semi")


def overlaid(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """A registry with another laid over it; the second wins field by field."""
    names = [c for c in base.columns if c != key]
    other = over.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    return base.join(other, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def unmatched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
