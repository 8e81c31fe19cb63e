"""Tables of the published snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.functions.columns import METRICS, passes, squeezed


def leaderboard(consensus: DataFrame) -> DataFrame:
    """Models by mean score, best first."""
    out = consensus.groupBy("config_id").agg(F.count("*").alias("cases"), F.avg("overall").alias("average"), F.avg(F.col("pass").cast("int")).alias("pass_rate"), F.count_if(F.col("agreement_status") == "review_needed").alias("review_needed"))
    # one row for each model: a single small window
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("average"), "config_id")))


def case_gates(consensus: DataFrame) -> DataFrame:
    """Quality, agreement and final gate of each answer."""
    quality = F.when(F.col("pass"), "pass").otherwise("fail")
    agreement = F.when(F.col("agreement_status") == "review_needed", "review").when(F.col("agreement_status") == "borderline", "monitor").otherwise("pass")
    out = consensus.withColumns({"quality_gate": quality, "judge_agreement_gate": agreement})
    return out.withColumn("final_gate", F.when(F.col("judge_agreement_gate") == "review", "review").otherwise(F.col("quality_gate")))


def gate_summary(gates: DataFrame) -> DataFrame:
    """Counts of the three gates by value for each model."""
    values = {"quality_gate": ("pass", "fail"), "judge_agreement_gate": ("pass", "monitor", "review"), "final_gate": ("pass", "fail", "review")}
    return gates.groupBy("config_id").agg(*[F.count_if(F.col(g) == v).alias(f"{g}_{v}") for g, vs in values.items() for v in vs])


def judge_summary(verdicts: DataFrame) -> DataFrame:
    """Each judge over all models and by model, in one pass."""
    out = verdicts.groupingSets([[F.col("judge_id")], [F.col("judge_id"), F.col("config_id")]], F.col("judge_id"), F.col("config_id"))
    return out.agg(F.count("*").alias("n"), F.avg("overall").alias("average"), F.min("overall").alias("lowest"), F.max("overall").alias("highest"), F.avg(F.col("pass").cast("int")).alias("pass_rate"), *[F.avg(m).alias(m) for m in METRICS])


def run_summary(consensus: DataFrame) -> DataFrame:
    """Rows, average, lowest, highest and passes of a run."""
    return consensus.agg(F.count("*").alias("n"), F.avg("overall").alias("average"), F.min("overall").alias("lowest"), F.max("overall").alias("highest"), F.count_if("pass").alias("passed"))


DIMENSIONS = ("qa_category", "question_type", "qa_topic", "dataset_role")
SLICES = (("qa_category",), ("question_type",), ("qa_topic",), ("dataset_role",), ("qa_category", "question_type"), ("qa_category", "qa_topic"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Halves go up, whatever order a sum was taken in."""
    return F.round(c + 10.0 ** -(digits + 3), digits)


def snapshot_fact(verdicts: DataFrame, cases: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """A row for each judged answer with its case's labels: what all tables of a snapshot derive from.

    ``verdicts`` are normalised, with seq and perhaps reason; ``cases`` has case_id and any of ``DIMENSIONS``
    and expected_behavior; ``models`` names the models, else their ids do. Metrics are plain means to six
    digits, the overall score is the mean of those that apply; the error is that of the lowest judge that
    names one; reasons stand in judging order. ``scores`` keeps each judge's verdict. Answers to unknown
    cases have no row. One aggregation on (config_id, case_id), then the joins.
    """
    reason = F.nullif(squeezed(F.col("reason")), F.lit("")) if "reason" in verdicts.columns else F.lit(None).cast("string")
    score = F.coalesce("overall", F.lit(0.0))
    widest = F.greatest(*[F.coalesce(F.max(m) - F.min(m), F.lit(0.0)) for m in METRICS])
    told = F.struct("seq", "judge_id", score.alias("overall"), "pass", *METRICS, reason.alias("reason"))
    out = verdicts.groupBy("config_id", "case_id").agg(
        *[rounded(F.avg(m)).alias(m) for m in METRICS], rounded(F.max(score) - F.min(score)).alias("overall_gap"), rounded(widest).alias("metric_max_gap"),
        (F.bool_or("pass") & F.bool_or(~F.col("pass"))).alias("pass_mismatch"), F.coalesce(F.bool_or("critical_fail"), F.lit(False)).alias("critical_fail"),
        F.coalesce(F.min_by("error_type", F.when(F.col("error_type") != "normal", F.struct(score, "seq"))), F.lit("normal")).alias("error_type"), F.array_sort(F.collect_list(told)).alias("scores"),
    )
    count = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    total = sum((F.coalesce(m, F.lit(0.0)) for m in METRICS), F.lit(0.0))
    out = out.withColumns({"score_denominator": count, "raw_metric_score": rounded(total), "overall": F.coalesce(rounded(F.try_divide(total, count)), F.lit(0.0)), "hal_rate": rounded(1 - F.col("hal_pass"))})
    status = F.when(F.col("pass_mismatch") | (F.col("overall_gap") >= 0.3), "review_needed").when(F.col("overall_gap") >= 0.15, "borderline").otherwise("stable")
    out = out.withColumns({"pass": passes(F.col("overall"), F.col("critical_fail")), "agreement_status": status})
    said = F.filter("scores", lambda s: s["reason"].isNotNull())
    out = out.withColumns({"review_priority": F.when(status == "review_needed", "high").when(status == "borderline", "medium").otherwise("low"), "judge_reason": F.array_join(F.transform(said, lambda s: F.concat_ws(": ", s["judge_id"], s["reason"])), " | ")})
    labels = [F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown")).alias(c) if c in cases.columns else F.lit("unknown").alias(c) for c in (*DIMENSIONS, "expected_behavior")]
    out = out.join(cases.select("case_id", *labels), "case_id")
    if models is None:
        return out.withColumn("model", F.col("config_id"))
    return out.join(models.select("config_id", "model"), "config_id", "left").withColumn("model", F.coalesce("model", "config_id"))


def gate_scores(fact: DataFrame) -> DataFrame:
    """The three gates of each answer and why."""
    out = case_gates(fact)
    why = F.when(F.col("quality_gate") == "pass", "overall_score >= 0.60 and no critical_fail").when(F.col("critical_fail"), "critical_fail").otherwise("overall_score < 0.60")
    both = F.concat(F.lit("quality_gate="), F.col("quality_gate"), F.lit("; judge_agreement_gate="), F.col("judge_agreement_gate"))
    names = ("case_id", "config_id", "model", *DIMENSIONS[:3], "expected_behavior", "overall", "quality_gate", "judge_agreement_gate", "agreement_status", "overall_gap", "metric_max_gap", "review_priority", "final_gate", "error_type")
    return out.select(*names, why.alias("quality_gate_reason"), both.alias("final_gate_reason"), F.col("final_gate").alias("release_recommendation"))


def snapshot_cells(fact: DataFrame, digits: int = 6, rate_digits: int = 4) -> DataFrame:
    """Each model as a whole (dimension null) and by the four labels and two pairs of them: means, passes and gates.

    One pass over grouping sets; a fact has one row for each answer, so rows are cases. Means leave out metrics that
    do not apply and are 0 where none does.
    """
    gates = case_gates(fact)
    sets = [[F.col("config_id")], *[[F.col("config_id"), *map(F.col, s)] for s in SLICES]]
    counts = {"quality_gate": ("pass", "fail"), "judge_agreement_gate": ("pass", "monitor", "review"), "final_gate": ("pass", "fail", "review")}
    means = [F.coalesce(rounded(F.avg(m), digits), F.lit(0.0)).alias(m) for m in ("overall", "acc", "com", "nac", "hal_rate", "hal_pass")]
    out = gates.groupingSets(sets, "config_id", *DIMENSIONS).agg(F.grouping_id().alias("_g"), F.max("model").alias("model"), F.count("*").alias("rows"), rounded(F.avg(F.col("pass").cast("int")), rate_digits).alias("pass_rate"), *means, *[F.count_if(F.col(g) == v).alias(f"{g}_{v}") for g, vs in counts.items() for v in vs])
    kept = [F.expr(f"(_g & {8 >> k}) = 0") for k in range(4)]
    named = F.concat_ws("|", *[F.when(k, F.lit(n)) for k, n in zip(kept, DIMENSIONS, strict=True)])
    value = F.concat_ws(" / ", *[F.when(k, F.col(n)) for k, n in zip(kept, DIMENSIONS, strict=True)])
    out = out.withColumns({"dimension": F.nullif(named, F.lit("")), "value": F.nullif(value, F.lit("")), "level": F.when(named != "", F.when(named.contains("|"), "2d").otherwise("1d"))})
    return out.drop("_g", *DIMENSIONS)


def snapshot_judges(fact: DataFrame, digits: int = 6, rate_digits: int = 4) -> DataFrame:
    """Each judge over all models (config_id null) and by model, from the verdicts that the fact keeps."""
    each = fact.select("config_id", F.explode("scores").alias("s")).select("config_id", "s.*").withColumn("hal_rate", 1 - F.col("hal_pass"))
    means = [F.coalesce(rounded(F.avg(m), digits), F.lit(0.0)).alias(m) for m in ("overall", "acc", "com", "nac", "hal_rate", "hal_pass")]
    out = each.groupingSets([[F.col("judge_id")], [F.col("judge_id"), F.col("config_id")]], F.col("judge_id"), F.col("config_id"))
    return out.agg(F.grouping("config_id").alias("_all"), F.count("*").alias("rows"), *means, F.min("overall").alias("lowest"), F.max("overall").alias("highest"), rounded(F.avg(F.coalesce("pass", F.lit(False)).cast("int")), rate_digits).alias("pass_rate")).withColumn("by_model", F.col("_all") == 0).drop("_all")


def snapshot_tables(fact: DataFrame, cells: DataFrame, judges: DataFrame, *, run_id: str, eval_date: str) -> dict[str, DataFrame]:
    """The runtime and score tables of a snapshot besides the fact itself (S25); all but the case tables are small and come from ``cells`` and ``judges``."""
    whole, means = cells.where("dimension is null"), ("overall", "acc", "com", "nac", "hal_rate", "hal_pass")
    # a row for each model: a single small window
    ranked = whole.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall"), "config_id")))
    run = {"run_id": F.lit(run_id), "eval_date": F.lit(eval_date)}
    gates = ("quality_gate_pass", "quality_gate_fail", "judge_agreement_gate_pass", "judge_agreement_gate_monitor", "judge_agreement_gate_review", "final_gate_pass", "final_gate_fail", "final_gate_review")
    case_names = [c for c in fact.columns if c not in ("scores", "dataset_role", "critical_fail")]
    definition = fact.sparkSession.createDataFrame([("acc", "higher_is_better", True), ("com", "higher_is_better", True), ("nac", "higher_is_better", True), ("hal_rate", "lower_is_better", False), ("hal_pass", "higher_is_better", True)], "metric string, direction string, in_overall boolean")
    none = {"release_gate": F.lit("not_applicable"), "gate_eligible_cases": F.lit(0), "evaluated_cases": F.col("rows"), "core_pass_rate": F.col("pass_rate"), "reason": F.lit("no gate-eligible cases")}
    return {
        "eval_runs": whole.withColumns(run).select("run_id", "eval_date", "config_id", "model", F.col("rows").alias("total_questions"), F.col("rows").alias("scored_questions"), "pass_rate", *means),
        "qa_slice_scores": cells.where("dimension is not null").select("config_id", "model", "level", "dimension", "value", F.col("rows").alias("case_count"), F.when(F.col("rows") >= 30, "reliable").otherwise("low_sample").alias("reliability"), "pass_rate", *means),
        "run_release_gates": whole.withColumns(run | none).select("run_id", "config_id", "model", *none),
        "case_scores": fact.select(*case_names), "gate_scores": gate_scores(fact), "model_gate_summary": whole.select("config_id", "model", "rows", *gates),
        "model_scores": whole.select("config_id", "model", "rows", "pass_rate", *means), "target_model_scores": ranked.withColumns(run).select("rank", "run_id", "config_id", "model", "eval_date", "rows", "pass_rate", *means),
        "judge_scores_overall": judges.where("not by_model").drop("by_model", "config_id"), "judge_scores_by_target_model": judges.where("by_model").drop("by_model"), "metric_definition": definition,
    }
