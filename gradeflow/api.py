"""The library's entry points: compose, score, select, merge, snapshot, compare, blend anew (survey 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.columns import PASS_THRESHOLD
from gradeflow.operators import apply, compare, compose, facts, judges, merge, review, scoring, snapshot, tables, traces
from gradeflow.sources import files

__all__ = ["compare_judges", "compose_set", "merge_judges", "publish_snapshot", "reblend", "score", "score_tool_traces", "select_outputs", "snapshot_tables"]


def compose_set(cases: DataFrame, pools: list[compose.Pool], *, seed: str, profile: str = "", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """An evaluation set and its summary."""
    out = compose.composed(cases, pools, seed=seed, profile=profile, strict=strict)
    return out, compose.summary(out)


def score(answers: DataFrame, verdicts: DataFrame | None = None, *, mode: str = "audit", weight: float = 0.5, method: str = "auto", weights: dict[str, float] | None = None, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """Answers scored by rules and, with normalised verdicts, by judges: audit, override or blend."""
    static = scoring.scored(answers, threshold=threshold)
    if verdicts is None:
        return static
    both = apply.attached(static.withColumnRenamed("overall_score", "overall"), judges.aggregated(verdicts, method, weights))
    return apply.applied(both, mode, weight, threshold)


def select_outputs(outputs: DataFrame, cases: DataFrame, *, configs: list[str] | None = None, keys: DataFrame | None = None, complete_only: bool = False) -> DataFrame:
    """Answers of the given models and keys, of complete models only if asked for."""
    out = outputs.where(F.col("config_id").isin(configs)) if configs else outputs
    out = review.of_keys(out, keys) if keys is not None else out
    return facts.complete_only(out, cases) if complete_only else out


def merge_judges(runs: list[DataFrame], *, policy: str = "review", arbiter_id: str | None = None, method: str = "auto", min_ok: int = 1) -> tuple[DataFrame, DataFrame]:
    """One verdict for each answer from several judge runs, and the summary of the merge."""
    out = merge.merged(judges.normalised(merge.united(runs)), arbiter_id=arbiter_id, policy=policy, method=method, min_ok=min_ok)
    return out, merge.merge_summary(out)


def snapshot_tables(verdicts: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    """The tables of a published snapshot from normalised verdicts (S25): case scores, leaderboard, slices, gates, judges, run."""
    case_scores = judges.consensus(verdicts)
    gates = snapshot.case_gates(case_scores)
    return {"case_scores": case_scores, "leaderboard": snapshot.leaderboard(case_scores), "slices": tables.slices(case_scores, cases), "gates": gates, "gate_summary": snapshot.gate_summary(gates), "judge_summary": snapshot.judge_summary(verdicts), "run_summary": snapshot.run_summary(case_scores), "conflicts": judges.conflicts(verdicts)}


def publish_snapshot(verdicts: DataFrame, cases: DataFrame, path: str, *, run_id: str, eval_date: str, models: DataFrame | None = None) -> DataFrame:
    """Write the runtime and score tables of a snapshot and make it the current run of ``path`` (S18, S25); returns its manifest.

    Verdicts are read once: the fact is written first, with each judge's verdicts, and all else derives from what
    was written. Cells and judges are two aggregations of the fact, the small tables selections of these.
    ``files.read_current`` reads a table; until the last step readers see the former run whole.
    """
    spark = verdicts.sparkSession
    root = f"{path}/runs/{run_id}"
    counts = files.write_run_tables({"question_cases": snapshot.snapshot_fact(verdicts, cases, models)}, path, run_id)
    fact = spark.read.parquet(f"{root}/question_cases")
    counts |= files.write_run_tables({"cells": snapshot.snapshot_cells(fact), "judges": snapshot.snapshot_judges(fact)}, path, run_id)
    small = [spark.read.parquet(f"{root}/{n}") for n in ("cells", "judges")]
    counts |= files.write_run_tables(snapshot.snapshot_tables(fact, *small, run_id=run_id, eval_date=eval_date), path, run_id)
    made = spark.createDataFrame(sorted(counts.items()), "table string, rows long")
    files.write_run_tables({"manifest": made}, path, run_id)
    files.point_to(spark, path, run_id)
    return made


def score_tool_traces(scenarios: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of tool-agent traces and their summary."""
    out = traces.scored_traces(scenarios, predictions)
    return out, traces.trace_summary(out)


def compare_judges(base: DataFrame, candidate: DataFrame, *, mode: str = "points", threshold: float = 0.3, error_types: bool = True, arbiter: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers that two judge runs scored, with what sets them apart, and the report."""
    pairs = compare.marked(base, candidate, mode=mode, threshold=threshold, error_types=error_types, arbiter=arbiter)
    return pairs, compare.report(pairs, base, candidate)


def reblend(saved: DataFrame, *, mode: str, weight: float, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """A saved run under another mode, weight or threshold."""
    return apply.reblended(saved, mode, weight, threshold)
