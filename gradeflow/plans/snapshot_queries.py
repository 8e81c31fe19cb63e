"""Tables of a published snapshot over the derived verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import judges, snapshot
from gradeflow.plans import fixtures as fx
from gradeflow.plans.queries import _NORMAL, query

_MS = ("acc", "com", "nac", "hal_pass")
_UP = lambda c, n=6: f"round({c} + 1e-{n + 3}, {n})"
_LABELS = f"SELECT case_id, qa_category, question_type, qa_topic, CASE WHEN active THEN severity ELSE 'unknown' END AS dataset_role FROM ({fx.CASES_SQL})"
_FACT = f"""{_NORMAL}, g AS (SELECT config_id, case_id, {", ".join(f"{_UP(f'avg({m})')} AS {m}" for m in _MS)}, {_UP("max(overall) - min(overall)")} AS overall_gap, {_UP(f"greatest({', '.join(f'coalesce(max({m}) - min({m}), 0)' for m in _MS)})")} AS metric_max_gap,
  count(DISTINCT pass) > 1 AS pass_mismatch, bool_or(critical_fail) AS critical_fail, coalesce(arg_min(error_type, struct_pack(o := overall, s := seq)) FILTER (WHERE error_type <> 'normal'), 'normal') AS error_type,
  string_agg('j' || seq || ': seen by j' || seq, ' | ' ORDER BY seq) FILTER (WHERE seq <> 1) AS judge_reason FROM p GROUP BY 1, 2),
h AS (SELECT *, 2 + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT AS score_denominator, {_UP("acc + coalesce(com, 0) + coalesce(nac, 0) + hal_pass")} AS raw_metric_score, {_UP("(acc + coalesce(com, 0) + coalesce(nac, 0) + hal_pass) / (2 + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT)")} AS overall, {_UP("1 - hal_pass")} AS hal_rate FROM g),
f AS (SELECT *, overall >= 0.6 AND NOT critical_fail AS pass, CASE WHEN pass_mismatch OR overall_gap >= 0.3 THEN 'review_needed' WHEN overall_gap >= 0.15 THEN 'borderline' ELSE 'stable' END AS agreement_status FROM h JOIN ({_LABELS}) USING (case_id)),
q AS (SELECT *, CASE WHEN pass THEN 'pass' ELSE 'fail' END AS quality_gate, CASE agreement_status WHEN 'review_needed' THEN 'review' WHEN 'borderline' THEN 'monitor' ELSE 'pass' END AS judge_agreement_gate FROM f)"""
_AVERAGES = ", ".join(f"coalesce({_UP(f'avg({m})', 9)}, 0) AS {m}" for m in ("overall", "acc", "com", "nac", "hal_rate", "hal_pass"))


def _fact(spark: SparkSession, d: str) -> DataFrame:
    v = judges.normalised(fx.verdicts(spark, d)).withColumn("reason", F.when(F.col("seq") != 1, F.concat(F.lit(" seen  by "), "judge_id")))
    cases = fx.cases(spark, d).withColumn("dataset_role", F.when(F.col("active"), F.col("severity")))
    return snapshot.snapshot_fact(v, cases)


@query(f"""WITH {_FACT} SELECT config_id, case_id, qa_category, qa_topic, dataset_role, acc, com, nac, hal_pass, hal_rate, score_denominator, raw_metric_score, overall, pass, overall_gap, metric_max_gap, error_type, agreement_status,
  CASE agreement_status WHEN 'review_needed' THEN 'high' WHEN 'borderline' THEN 'medium' ELSE 'low' END AS review_priority, judge_reason FROM f""")
def snapshot_case_scores(spark, d):
    """S25, A5e, A6, A8, P32: the fact that a snapshot's tables derive from."""
    return _fact(spark, d).select("config_id", "case_id", "qa_category", "qa_topic", "dataset_role", *_MS, "hal_rate", "score_denominator", "raw_metric_score", "overall", "pass", "overall_gap", "metric_max_gap", "error_type", "agreement_status", "review_priority", "judge_reason")


@query(f"""WITH {_FACT} SELECT config_id, case_id, CASE judge_agreement_gate WHEN 'review' THEN 'review' ELSE quality_gate END AS final_gate, CASE WHEN pass THEN 'overall_score >= 0.60 and no critical_fail' WHEN critical_fail THEN 'critical_fail' ELSE 'overall_score < 0.60' END AS quality_gate_reason,
  'quality_gate=' || quality_gate || '; judge_agreement_gate=' || judge_agreement_gate AS final_gate_reason FROM q""")
def snapshot_gate_scores(spark, d):
    """The gates of each answer and why."""
    return snapshot.gate_scores(_fact(spark, d)).select("config_id", "case_id", "final_gate", "quality_gate_reason", "final_gate_reason")


_DIMENSIONS = [(None, None), *[("|".join(s), " || ' / ' || ".join(s)) for s in snapshot.SLICES]]


@query(f"WITH {_FACT} " + " UNION ALL ".join(f"SELECT config_id, {repr(n) if n else 'NULL'} AS dimension, {v or 'NULL'} AS value, count(*) AS n, {_UP('avg(pass::INT)', 9)} AS pass_rate, {_AVERAGES}, count(*) FILTER (WHERE judge_agreement_gate = 'monitor') AS monitored, count(*) FILTER (WHERE judge_agreement_gate <> 'review' AND quality_gate = 'pass') AS passed FROM q GROUP BY config_id{', ' + ', '.join(n.split('|')) if n else ''}" for n, v in _DIMENSIONS))
def snapshot_cells(spark, d):
    """Models as a whole, by four labels and two pairs of them, in one pass."""
    return snapshot.snapshot_cells(_fact(spark, d), digits=9, rate_digits=9).select("config_id", "dimension", "value", F.col("rows").alias("n"), "pass_rate", "overall", "acc", "com", "nac", "hal_rate", "hal_pass", F.col("judge_agreement_gate_monitor").alias("monitored"), F.col("final_gate_pass").alias("passed"))


@query(f"WITH {_NORMAL}, e AS (SELECT *, 1 - hal_pass AS hal_rate FROM p) " + " UNION ALL ".join(f"SELECT judge_id, {c} AS config_id, count(*) AS n, {_AVERAGES}, round(min(overall), 6) AS lowest, round(max(overall), 6) AS highest, {_UP('avg(pass::INT)', 9)} AS pass_rate FROM e GROUP BY judge_id{g}" for c, g in (("NULL", ""), ("config_id", ", config_id"))))
def snapshot_judges(spark, d):
    """Judges over all models and by model, from the verdicts that the fact keeps."""
    out = snapshot.snapshot_judges(_fact(spark, d), digits=9, rate_digits=9)
    return out.select("judge_id", "config_id", F.col("rows").alias("n"), "overall", "acc", "com", "nac", "hal_rate", "hal_pass", *[F.round(c, 6).alias(c) for c in ("lowest", "highest")], "pass_rate")
