"""Merging the runs of independent judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.operators.judges import KEY, latest, resolved

# What failed calls of a judge say.
REFUSED = "refused_by_provider_policy"
REFUSAL_MARK = "cyber_policy"
SANITIZED = ("sanitized safety-evaluation", "safety_sanitized_eval", "original unsafe request text was abstracted")
TRANSIENT = ("http error 429", "http error 500", "http error 502", "http error 503", "http error 504", "http error 520", "timeout", "timed out", "temporarily unavailable", "remote end closed", "connection reset", "did not return a json object")
QUOTA = ("exceeded your current quota", "insufficient_quota", "check your plan and billing", "billing details")
RATE = ("http error 429", "too many requests", "rate limit")


def _says(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def error_classes(status: Column, reason: Column) -> dict[str, Column]:
    """Whether a judge's call was refused by policy, judged a sanitised text, failed for a moment, or met a rate limit, and how many seconds to wait."""
    s, text = F.lower(F.trim(F.coalesce(status, F.lit("")))), F.lower(F.coalesce(reason, F.lit("")))
    wait = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")
    seconds = F.coalesce(wait(r"retry_after=([0-9]+(?:\.[0-9]+)?)"), wait(r"try again in ([0-9]+(?:\.[0-9]+)?)s"), wait(r"try again in ([0-9]+(?:\.[0-9]+)?)m") * 60, F.lit(0.0))
    failed = s == "error"
    return {"refused": (s == REFUSED) | text.contains(REFUSAL_MARK), "sanitized": _says(text, SANITIZED), "transient": failed & _says(text, TRANSIENT), "rate_limited": failed & ~_says(text, QUOTA) & _says(text, RATE), "retry_after": seconds}


def united(runs: list[DataFrame]) -> DataFrame:
    """Rows of several judge runs with their place as ``run``."""
    out = runs[0].withColumn("run", F.lit(0))
    for k, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn("run", F.lit(k)), allowMissingColumns=True)
    return out


def needs_review(row_status: Column, unresolved: Column, human: Column) -> Column:
    """Rows that people must look at."""
    return F.coalesce(row_status == REFUSED, F.lit(False)) | F.coalesce(unresolved, F.lit(False)) | F.coalesce(human, F.lit(False))


def merged(rows: DataFrame, *, arbiter_id: str | None = None, policy: str = "review", method: str = "auto", min_ok: int = 1) -> DataFrame:
    """One verdict for each answer from the rows of all judge runs (A10).

    ``rows`` are normalised verdicts with run, seq, judge_id, status and reason. Of a judge's good rows
    on an answer the latest counts (W2, W8). Conflicts are settled by ``policy``. With fewer than ``min_ok``
    good judges the answer takes its last failed row, refused and sanitised ones first (W7), or
    drops out if it has none. An answer with any refused or sanitised row goes to people.
    """
    classes = error_classes(F.col("status"), F.col("reason"))
    told = rows.withColumn("_blocked", classes["refused"] | classes["sanitized"])
    # dealt by answer once, so that the windows, sums and joins below need no further shuffle
    good = latest(told.where((F.lower("status") == "ok") & ~F.col("_blocked")).repartition(*KEY))
    of_answer = Window.partitionBy(*KEY)
    per_key = good.groupBy(*KEY).agg(F.count("*").alias("ok_judges"))
    counted = good.withColumns({"ok_judges": F.count("*").over(of_answer), "_base": F.count_if(F.col("judge_id") != F.lit(arbiter_id or "")).over(of_answer)})
    enough = counted.where(F.col("ok_judges") >= max(1, min_ok))
    # where only the arbiter spoke, it is the base
    is_base = (F.col("judge_id") != F.lit(arbiter_id or "")) | (F.col("_base") == 0)
    drop = ("_blocked", "_base", "ok_judges", "run", "status", "reason")
    settled = resolved(enough.where(is_base).drop(*drop), enough.where(~is_base).drop(*drop), policy, method)
    settled = settled.select(*KEY, "overall", "pass", "critical_fail", "error_type", "conflict", "resolution", "unresolved")
    failed = told.where(F.col("_blocked") | (F.lower("status") == "error"))
    last = F.max_by(F.struct("status", "reason"), F.struct("_blocked", "run", "seq"))
    about = told.groupBy(*KEY).agg(F.bool_or("_blocked").alias("_manual"), F.array_join(F.array_sort(F.collect_set(F.col("run").cast("string"))), ",").alias("runs"))
    out = about.join(per_key, list(KEY), "left").join(settled, list(KEY), "left").join(failed.groupBy(*KEY).agg(last.alias("_last")), list(KEY), "left")
    out = out.where(F.col("overall").isNotNull() | F.col("_last").isNotNull())
    status = F.when(F.col("_manual"), REFUSED).when(F.col("overall").isNotNull(), "ok").otherwise(F.col("_last")["status"])
    reason = F.when(F.col("overall").isNull() & ~F.col("_manual"), F.col("_last")["reason"])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) | F.col("_manual")
    return out.select(*KEY, status.alias("status"), F.coalesce("ok_judges", F.lit(0)).alias("ok_judges"), "overall", "pass", "critical_fail", "error_type", flag("conflict").alias("conflict"), F.when(F.col("_manual"), "manual_review_required").otherwise(F.col("resolution")).alias("resolution"), flag("unresolved").alias("unresolved"), flag("unresolved").alias("human_review_required"), reason.alias("reason"), "runs")


def merge_summary(out: DataFrame) -> DataFrame:
    """(figure, value, n): rows by status and by good judges, and how many are in conflict, unresolved or for people."""
    counted = lambda figure, c: out.groupBy(F.lit(figure).alias("figure"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
    flags = out.agg(*[F.count_if(F.col(c)).alias(c) for c in ("conflict", "unresolved", "human_review_required")])
    each = flags.select(F.explode(F.array(*[F.struct(F.lit("rows").alias("figure"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in flags.columns])).alias("e")).select("e.*")
    return counted("status", "status").unionByName(counted("ok_judges", "ok_judges")).unionByName(each)


def resumable(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Finished scores whose judge, prompt and policy are still the ones wanted (F12); ``wanted`` has a row for each judge."""
    return scores.where(F.lower("status").isin("ok", REFUSED)).join(wanted, ["judge_id", "prompt_hash"], "left_semi")


def judge_weights(v: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``weight`` of each verdict: by judge, else provider, else model, and the weights of an answer's verdicts add up to 1 (J17); null where none has any."""
    total = sum(w for w in weights.values() if w >= 0)
    kept = {k: w / total for k, w in weights.items() if w >= 0} if total > 0 else {}
    if not kept:
        return v.withColumn("weight", F.lit(None).cast("double"))
    held = F.create_map(*[F.lit(x) for kv in kept.items() for x in kv])
    own = F.coalesce(*[F.try_element_at(held, F.col(c)) for c in ("judge_id", "provider", "model")], F.lit(0.0))
    marked = v.withColumn("_w", own)
    sums = marked.groupBy(*KEY).agg(F.sum("_w").alias("_t"))
    return marked.join(sums, list(KEY)).withColumn("weight", F.try_divide(F.col("_w"), F.nullif(F.col("_t"), F.lit(0.0)))).drop("_w", "_t")
