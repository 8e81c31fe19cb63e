"""Verdicts of many judges: normalise, aggregate, disagree, arbitrate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.functions.columns import CONFLICT_GAP, ERROR_TYPES, METRICS, applicable_mean, error_type, passes, raw_metrics

KEY = ("config_id", "case_id")


def normalised(verdicts: DataFrame) -> DataFrame:
    """Verdicts with metrics from 0 to 1, overall score and pass."""
    out = verdicts.withColumns(raw_metrics(*(F.col(c) for c in ("accuracy", "completeness", "numerical_accuracy", "hallucination"))))
    out = out.withColumn("overall", applicable_mean(*(F.col(m) for m in METRICS))).withColumn("error_type", error_type(F.col("error_type")))
    return out.withColumn("pass", passes(F.col("overall"), F.col("critical_fail")))


def latest(verdicts: DataFrame) -> DataFrame:
    """Of several verdicts by one judge on one answer the last in run order."""
    w = Window.partitionBy(*KEY, "judge_id").orderBy(F.desc("run"), F.desc("seq"))
    return verdicts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def aggregated(v: DataFrame, method: str = "auto", weights: dict[str, float] | None = None) -> DataFrame:
    """One verdict for each answer from normalised verdicts (A5).

    ``mean``, ``weighted_mean`` (weights by judge, renormalised over those that apply),
    ``trimmed_mean`` (without the lowest and the highest of three or more), ``max`` and ``min`` (the
    whole verdict of the best or worst judge, first in order on ties), ``auto`` (weighted with
    weights, mean for fewer than three judges, else trimmed). Pass follows from the overall
    score and whether any judge saw a critical failure; the error type is that of the lowest judge
    that names one. One aggregation on (config_id, case_id).
    """
    if weights:
        v = v.withColumn("_w", F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("judge_id")], F.lit(0.0)))
    else:
        v = v.withColumn("_w", F.lit(1.0))
    count, low, high, total = F.count, F.min, F.max, F.sum

    def mean(m: str):
        return F.avg(m)

    def trimmed(m: str):
        return F.when(count(m) >= 3, F.try_divide(total(m) - low(m) - high(m), count(m) - 2)).otherwise(F.avg(m))

    def weighted(m: str):
        held = F.sum(F.when(F.col(m).isNotNull(), F.col("_w")))
        return F.when(held > 0, F.try_divide(F.sum(F.col(m) * F.col("_w")), held)).otherwise(F.avg(m))

    def selected(m: str):
        row = F.struct(F.col(m).alias("x"))
        order = F.struct(F.col("overall") if method == "min" else -F.col("overall"), F.col("seq"))
        return F.min_by(row, order)["x"]

    if method == "auto":
        pick = (lambda m: weighted(m)) if weights else (lambda m: F.when(F.count("*") >= 3, trimmed(m)).otherwise(mean(m)))
    else:
        pick = {"mean": mean, "weighted_mean": weighted, "trimmed_mean": trimmed, "max": selected, "min": selected}[method]
    wrong = F.when(F.col("error_type") != "normal", F.struct("overall", "seq"))
    out = v.groupBy(*KEY).agg(*[pick(m).alias(m) for m in METRICS], F.bool_or("critical_fail").alias("critical_fail"), F.coalesce(F.min_by("error_type", wrong), F.lit("normal")).alias("error_type"), F.count("*").alias("judges"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "judge_id"))), lambda s: s["judge_id"]), ",").alias("judge_ids"))
    out = out.withColumn("overall", applicable_mean(*(F.col(m) for m in METRICS)))
    return out.withColumn("pass", passes(F.col("overall"), F.col("critical_fail")))


def consensus(v: DataFrame) -> DataFrame:
    """Plain means, gaps and agreement of the judges on each answer."""
    gap = F.round(F.max("overall") - F.min("overall"), 6)
    widest = F.greatest(*[F.coalesce(F.max(m) - F.min(m), F.lit(0.0)) for m in METRICS])
    out = v.groupBy(*KEY).agg(*[F.avg(m).alias(m) for m in METRICS], F.avg("overall").alias("judge_average"), gap.alias("overall_gap"), widest.alias("metric_max_gap"), (F.bool_or("pass") & F.bool_or(~F.col("pass"))).alias("pass_mismatch"), F.bool_or("critical_fail").alias("critical_fail"), F.count("*").alias("judges"))
    out = out.withColumn("overall", applicable_mean(*(F.col(m) for m in METRICS)))
    status = F.when(F.col("pass_mismatch") | (F.col("overall_gap") >= 0.3), "review_needed").when(F.col("overall_gap") >= 0.15, "borderline").otherwise("stable")
    return out.withColumn("agreement_status", status).withColumn("pass", passes(F.col("overall"), F.col("critical_fail")))


def conflicts(v: DataFrame) -> DataFrame:
    """Whether judges disagree on an answer: on passing, by a gap of 0.3, or on the error."""
    # a flag for each known error type keeps to a hash aggregate; sets would be sorted
    kinds = sorted(t for t in ERROR_TYPES if t != "normal")
    flags = [F.bool_or(F.col("error_type") == t).alias(f"_{t}") for t in kinds]
    out = v.groupBy(*KEY).agg(*flags, F.count("*").alias("judges"), (F.bool_or("pass") & F.bool_or(~F.col("pass"))).alias("pass_conflict"), (F.max("overall") - F.min("overall")).alias("gap"))
    out = out.withColumn("errors", F.array_compact(F.array(*[F.when(F.col(f"_{t}"), t) for t in kinds]))).drop(*[f"_{t}" for t in kinds])
    several = F.col("judges") > 1
    reason = F.concat_ws("; ", F.when(F.col("pass_conflict"), "judge pass/fail disagreement"), F.when(F.col("gap") >= CONFLICT_GAP, F.format_string("judge score gap %.3f", "gap")), F.when(F.size("errors") > 1, F.concat(F.lit("judge error-type disagreement: "), F.array_join("errors", ", "))))
    return out.withColumn("reason", F.when(several, reason).otherwise("")).withColumn("conflict", F.col("reason") != "")


def resolved(v: DataFrame, arbiter: DataFrame, policy: str = "three_judge", method: str = "auto") -> DataFrame:
    """Settle conflicts by an arbiter's verdicts.

    ``none`` leaves them, ``review`` marks them for people, ``three_judge`` aggregates again
    with the arbiter, ``arbiter_override`` takes the arbiter's verdict. An answer in conflict
    without an arbiter's verdict stays unresolved.
    """
    base = aggregated(v, method).join(conflicts(v).select(*KEY, "conflict"), list(KEY))
    if policy in ("none", "review"):
        return base.withColumn("resolution", F.when(~F.col("conflict"), "none").otherwise(F.lit("unresolved" if policy == "none" else "review"))).withColumn("unresolved", F.col("conflict") & F.lit(policy == "review"))
    # what the arbiter says counts in conflicts only; asking it there alone would make the verdicts and conflicts above a second time
    votes = arbiter if policy == "arbiter_override" else v.join(arbiter.select(*KEY), list(KEY), "left_semi").unionByName(arbiter, allowMissingColumns=True)
    again = aggregated(votes, "mean" if policy == "arbiter_override" else method)
    names = [c for c in again.columns if c not in KEY]
    both = base.join(again.select(*KEY, *[F.col(c).alias(f"_{c}") for c in names]), list(KEY), "left")
    told = F.col("conflict") & F.col("_judges").isNotNull()
    out = both.select(*KEY, *[F.when(told, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names], "conflict", F.when(told, policy).when(F.col("conflict"), "unresolved").otherwise("none").alias("resolution"))
    return out.withColumn("unresolved", F.col("resolution") == "unresolved")
