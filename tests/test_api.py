"""The entry points over the smallest tables."""

from pyspark.sql import functions as F

from gradeflow import api
from gradeflow.operators import compose, judges
from gradeflow.plans import fixtures, merge_queries, review_queries
from gradeflow.sources import files

SF = "/root/testdata/sf0.001"


def test_scores_by_rules_and_judges(spark):
    answers = fixtures.answers(spark, SF).withColumn("config_id", F.lit("m0"))
    verdicts = judges.normalised(fixtures.verdicts(spark, SF)).where("config_id = 'm0'")
    static = {r.case_id: r.overall_score for r in api.score(answers).select("case_id", "overall_score").collect()}
    mixed = api.score(answers, verdicts, mode="blend", weight=0.0)
    assert {r.case_id: round(r.overall, 4) for r in mixed.select("case_id", "overall").collect()} == {k: round(v, 4) for k, v in static.items()}
    again = api.reblend(mixed, mode="override", weight=1.0, threshold=0.5)
    assert again.count() == len(static) and again.where("pass and overall < 0.5").count() == 0


def test_selection_merge_comparison_and_snapshot(spark):
    raw = fixtures.verdicts(spark, SF)
    runs = [raw.where(f"judge_id = 'j{k}'").withColumns({"status": F.lit("ok"), "reason": F.lit("")}) for k in range(3)]
    out, summary = api.merge_judges(runs, method="mean")
    assert out.count() == 1000 and {r.n for r in summary.where("figure = 'ok_judges'").collect()} == {1000}
    v = judges.normalised(raw)
    tables = api.snapshot_tables(v, fixtures.cases(spark, SF))
    assert tables["leaderboard"].count() == 5 and tables["case_scores"].count() == 1000 and tables["run_summary"].first().n == 1000
    pairs, report = api.compare_judges(v.where("judge_id = 'j0'"), v.where("judge_id = 'j1'"))
    row = report.first()
    assert row.matched_rows == pairs.count() == 1000 and row.candidate_higher_rows + row.baseline_higher_rows + row.same_score_rows == 1000
    outputs = v.where("judge_id = 'j0'").selectExpr("config_id", "case_id", "if(config_id = 'm1' and case_id = 3, 'error', 'ok') as status", "'x' as model_answer")
    cases = fixtures.cases(spark, SF)
    assert {r.config_id for r in api.select_outputs(outputs, cases, configs=["m0", "m1"], complete_only=True).select("config_id").distinct().collect()} == {"m0"}
    assert api.select_outputs(outputs, cases, keys=outputs.where("case_id = 3")).count() == 5


def test_sets_and_traces(spark):
    chosen, summary = api.compose_set(fixtures.frame(spark, SF, review_queries._POOLED), [compose.Pool("p0", 5), compose.Pool("p2", 4)], seed="x")
    assert chosen.count() == 9 and {r.value: r.n for r in summary.where("figure = 'selected'").collect()} == {"p0": 5, "p2": 4}
    scores, figures = api.score_tool_traces(*merge_queries.trace_tables(spark, SF))
    assert figures.where("figure = 'all'").first().total == scores.count() == 200


# Raw scores (accuracy, completeness, numerical accuracy, hallucination) of twenty answers, ten of each of two
# models, as the first judge saw them, and what a published snapshot of them says.
SCORED = {
    "d": [(0, 0, 0, 1), (0, 1, 0, 1), (0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 1), (1, 1, 0, 1), (0, 0, 0, 0), (1, 1, -1, 1), (1, 1, -1, 1)],
    "g": [(0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 0), (1, 1, 0, 0), (2, 2, 1, 0), (0, 0, 0, 0), (2, 1, -1, 0), (2, 1, -1, 0)],
}
KINDS = ["single", "single", "compare", "compare", "complex", "complex", "number", "number", "sensitive", "sensitive"]


def test_published_snapshot_of_twenty_answers(spark, tmp_path):
    rows = [(m, k, "openai", 1, *raw, "normal" if (m, k) == ("g", 6) else "missing_condition", f"  so\n{k} ") for m, all_ in SCORED.items() for k, raw in enumerate(all_)]
    rows += [(m, 7, "gemini", 0, 0, 0, 0, 0, "unsupported_claim", "no") for m in "dg"] + [("x", 99, "openai", 1, 2, 2, 1, 0, "normal", "")]
    raw = spark.createDataFrame(rows, "config_id string, case_id int, judge_id string, seq int, accuracy int, completeness int, numerical_accuracy int, hallucination int, error_type string, reason string").withColumn("critical_fail", F.lit(False))
    cases = spark.createDataFrame([(k, kind, "" if k == 0 else "t") for k, kind in enumerate(KINDS)], "case_id int, question_type string, qa_topic string")
    models = spark.createDataFrame([("g", "gemma")], "config_id string, model string")
    path = str(tmp_path)
    made = api.publish_snapshot(judges.normalised(raw), cases, path, run_id="r1", eval_date="2026-06-24", models=models)
    table = lambda name: files.read_current(spark, path, name)
    assert {r.table: r.rows for r in made.collect()} | {"manifest": 14} == {t: table(t).count() for t in [r.table for r in made.collect()] + ["manifest"]}
    assert made.where("table in ('question_cases', 'case_scores', 'gate_scores')").agg(F.min("rows"), F.max("rows")).first() == (20, 20)
    means = ["pass_rate", "overall", "acc", "com", "nac", "hal_rate", "hal_pass"]
    got = [tuple(r) for r in table("target_model_scores").orderBy("rank").select("rank", "config_id", "model", "rows", *means).collect()]
    assert got == [(1, "g", "gemma", 10, 0.3, 0.366667, 0.35, 0.25, 0.125, 0.4, 0.6), (2, "d", "d", 10, 0.0, 0.129167, 0.15, 0.2, 0.0, 0.9, 0.1)]
    judged = [tuple(r) for r in table("judge_scores_overall").orderBy("judge_id").select("judge_id", "rows", "overall", "lowest", "highest", *[m for m in means if m != "overall"]).collect()]
    assert [(*r[:2], round(r[2], 6), *r[3:]) for r in judged] == [("gemini", 2, 0.25, 0.25, 0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("openai", 20, 0.247917, 0.0, 1.0, 0.15, 0.25, 0.225, 0.0625, 0.65, 0.35)]
    assert sorted((r.judge_id, r.config_id, r.rows) for r in table("judge_scores_by_target_model").collect()) == [("gemini", "d", 1), ("gemini", "g", 1), ("openai", "d", 10), ("openai", "g", 10)]
    assert {r.config_id: tuple(r)[2:] for r in table("model_gate_summary").collect()} == {"g": (10, 3, 7, 10, 0, 0, 3, 7, 0), "d": (10, 0, 10, 10, 0, 0, 0, 10, 0)}
    one = {(r.config_id, r.case_id): r for r in table("case_scores").collect()}
    assert (one["d", 8].overall, one["d", 8].score_denominator, one["g", 8].overall, one["g", 8].raw_metric_score, one["g", 6].error_type) == (0.333333, 3, 0.833333, 2.5, "normal")
    assert one["g", 7].judge_reason == "gemini: no | openai: so 7" and one["g", 7].error_type == "unsupported_claim" and one["g", 7].agreement_status == "stable"
    cells = {(r.dimension, r.value): r for r in table("qa_slice_scores").where("config_id = 'g'").collect()}
    assert cells["question_type", "sensitive"].overall == 0.833333 and cells["question_type", "sensitive"].nac == 0.0 and cells["qa_topic", "unknown"].case_count == 1
    assert cells["qa_category|question_type", "unknown / number"].case_count == 2 and {r.reliability for r in cells.values()} == {"low_sample"}
    api.publish_snapshot(judges.normalised(raw.limit(0)), cases, path, run_id="r2", eval_date="2026-06-25")
    assert files.current_run(spark, path) == "r2" and table("case_scores").count() == 0 and spark.read.parquet(f"{path}/runs/r1/case_scores").count() == 20
