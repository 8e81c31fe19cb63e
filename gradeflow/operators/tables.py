"""Run tables from scores: model summary, regressions, gates, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.functions.columns import METRICS


def row_gate(unresolved: Column) -> Column:
    """Gate of one scored case."""
    review = F.col("critical_fail") | F.col("error_type").isin("behavior_violation", "hallucinated_policy")
    return F.when(~F.col("gate_eligible"), "not_applicable").when(unresolved, "review").when(F.col("error_type") == "unsafe_completion", "block").when(review, "review").when(F.col("pass"), "pass").when(F.col("severity").isin("high", "critical"), "block").otherwise("review")


def model_summary(scores: DataFrame, review: Column) -> DataFrame:
    """One row for each model; the scored-only figures leave out cases under review unless all are (A1)."""
    marked = scores.withColumn("_review", F.coalesce(review, F.lit(False)))
    only = lambda c: F.coalesce(F.avg(F.when(~F.col("_review"), c)), F.avg(c))
    won = F.col("pass").cast("int")
    scored = F.count_if(~F.col("_review"))
    return marked.groupBy("config_id").agg(F.count("*").alias("total_questions"), F.when(scored > 0, scored).otherwise(F.count("*")).alias("scored_questions"), F.count_if(F.col("_review")).alias("review_pending_count"), F.avg(won).alias("pass_rate"), F.avg("overall").alias("overall_score"), only(won).alias("scored_pass_rate"), only(F.col("overall")).alias("scored_average"), *[F.avg(m).alias(m) for m in METRICS])


def latency_means(outputs: DataFrame) -> DataFrame:
    """Mean latency of each model's good answers; null without any (A1)."""
    return outputs.groupBy("config_id").agg(F.avg(F.when(F.col("status") == "ok", F.col("latency_ms"))).alias("avg_latency_ms"), F.count_if(F.col("status") == "ok").alias("ok_answers"))


def regressions(scores: DataFrame, baseline: str, delta: float = 5.0) -> DataFrame:
    """Every other model's cases against the baseline's."""
    # the baseline's row of a case through a window, so that the scores are derived once
    first = F.max(F.when(F.col("config_id") == baseline, F.struct(F.col("overall").alias("o"), F.col("pass").alias("p")))).over(Window.partitionBy("case_id"))
    out = scores.withColumn("_b", first).where(F.col("_b").isNotNull() & (F.col("config_id") != baseline))
    out = out.withColumns({"baseline_pass": F.col("_b")["p"], "baseline_score": F.col("_b")["o"]}).drop("_b").withColumn("score_delta", F.col("overall") - F.col("baseline_score"))
    kind = F.when(F.col("baseline_pass") & ~F.col("pass"), "new_failure").when(~F.col("baseline_pass") & F.col("pass"), "fixed_failure").when(~F.col("baseline_pass"), "persistent_failure").when(F.col("score_delta") <= -delta, "score_drop").when(F.col("score_delta") >= delta, "score_gain").otherwise("stable")
    return out.withColumn("regression_type", kind)


def release_gates(scores: DataFrame, cases: DataFrame, core: Column, least: float, unresolved: Column | None = None) -> DataFrame:
    """Verdict on each model's release from its gate-eligible cases."""
    held = scores.join(cases.select("case_id", "gate_eligible", "severity", core.alias("_core")), "case_id", "left").fillna(False, ["gate_eligible", "_core"])
    held = held.withColumn("_gate", row_gate(unresolved if unresolved is not None else F.lit(False)))
    can = F.col("gate_eligible")
    count = lambda g: F.count_if(can & (F.col("_gate") == g))
    out = held.groupBy("config_id").agg(F.count("*").alias("evaluated_cases"), F.count_if(can).alias("gate_eligible_cases"), count("pass").alias("pass_count"), count("review").alias("review_count"), count("block").alias("block_count"), F.avg(F.when(can & F.col("_core"), F.col("pass").cast("int"))).alias("core_pass_rate"))
    short = F.coalesce(F.col("core_pass_rate") < least, F.lit(False)) & F.lit(least > 0)
    gate = F.when(F.col("gate_eligible_cases") == 0, "not_applicable").when((F.col("block_count") > 0) | short, "block").when(F.col("review_count") > 0, "review").otherwise("pass")
    reason = F.concat_ws("; ", F.when(F.col("block_count") > 0, F.concat(F.lit("block_cases="), "block_count")), F.when(short, F.lit("core_pass_rate below minimum")), F.when((F.col("block_count") == 0) & ~short & (F.col("review_count") > 0), F.concat(F.lit("review_cases="), "review_count")))
    out = out.withColumn("release_gate", gate)
    return out.withColumn("reason", F.when(gate == "not_applicable", "no gate-eligible cases").when(reason == "", "all case gates passed").otherwise(reason))


SETS = [("qa_category",), ("question_type",), ("qa_topic",), ("qa_category", "question_type"), ("qa_category", "qa_topic"), ("question_type", "qa_topic"), ("qa_category", "question_type", "qa_topic")]


def slices(scores: DataFrame, cases: DataFrame, least: int = 30) -> DataFrame:
    """Scores by one, two and three dimensions in one pass over grouping sets."""
    joined = scores.join(cases.select("case_id", "qa_category", "question_type", "qa_topic"), "case_id")
    cols = [F.col(c) for c in ("config_id", "qa_category", "question_type", "qa_topic")]
    sets = [[F.col("config_id"), *map(F.col, s)] for s in SETS]
    out = joined.groupingSets(sets, *cols).agg(F.grouping_id().alias("_g"), F.count_distinct("case_id").alias("case_count"), F.count("*").alias("row_count"), F.avg("overall").alias("overall"), F.avg(F.col("pass").cast("int")).alias("pass_rate"))
    names = ("qa_category", "question_type", "qa_topic")
    kept = [F.expr(f"(_g & {4 >> k}) = 0") for k in range(3)]
    dimension = F.concat_ws(" x ", *[F.when(k, F.lit(n)) for k, n in zip(kept, names, strict=True)])
    value = F.concat_ws(" | ", *[F.when(k, F.coalesce(F.col(n), F.lit("unknown"))) for k, n in zip(kept, names, strict=True)])
    return out.select("config_id", dimension.alias("dimension"), value.alias("value"), "case_count", "row_count", "overall", "pass_rate", F.when(F.col("case_count") >= least, "reliable").otherwise("insufficient_n").alias("reliability"))
