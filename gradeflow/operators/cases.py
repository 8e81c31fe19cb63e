"""Lifecycle of cases: status, gold, review, gate, behaviour, task, topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.columns import blank_to_null, parse_bool

# The states of a case and the behaviours that decide its task.
STATES = ("draft", "shadow", "active", "deprecated")
TASKS = {
    "tool_agent": ("tool_call_then_grounded_answer", "tool_call_then_answer", "tool_result_synthesis", "tool_creation_and_use"),
    "safety_refusal": ("answer_not_supported_or_refuse", "abstain_when_unsupported", "refuse_unsafe_request"),
    "format_constrained_grounded_qa": ("answer_from_source_with_json_format", "structured_output_required"),
    "clarification": ("ask_clarifying_question",),
}


def field(df: DataFrame, name: str) -> Column:
    """The row's own value, else that of its metadata, as trimmed text; blank counts as absent (M9)."""
    own = blank_to_null(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(own, blank_to_null(F.col("metadata")[name])) if "metadata" in df.columns else own


def flag(df: DataFrame, name: str) -> Column:
    """true, false or null; text that is neither in the row falls through to the metadata."""
    own = parse_bool(F.col(name)) if name in df.columns else F.lit(None).cast("boolean")
    return F.coalesce(own, parse_bool(F.col("metadata")[name])) if "metadata" in df.columns else own


def with_lifecycle(cases: DataFrame) -> DataFrame:
    """Cases with case_status, gold_verified, human_review_required and gate_eligible resolved.

    A known case_status stands; else the source's status decides: active only with a verified answer,
    candidates and generated ones are drafts, anything else is shadow. Only active, verified cases
    that nothing excludes gate a release; benchmark cases must say so themselves.
    """
    told, source = F.lower(field(cases, "case_status")), F.lower(field(cases, "status"))
    gold = F.coalesce(flag(cases, "gold_verified"), F.lit(False))
    status = F.when(told.isin(*STATES), told).when(source.isin("shadow", "draft", "deprecated"), source).when(source.isin("candidate", "generated"), "draft").when((source == "active") & gold, "active").otherwise("shadow")
    base = F.coalesce(flag(cases, "gate_eligible"), F.coalesce(F.lower(field(cases, "dataset_role")), F.lit("")) != "benchmark")
    allowed = F.coalesce(flag(cases, "release_gate_eligible"), F.lit(True)) & ~F.coalesce(flag(cases, "deprecated"), F.lit(False))
    review = flag(cases, "human_review_required")
    out = cases.withColumns({"_status": status, "_gold": gold, "_base": base & allowed, "_review": review})
    return out.withColumns({
        "case_status": F.col("_status"),
        "gold_verified": F.col("_gold"),
        "human_review_required": F.coalesce("_review", F.col("_status").isin("draft", "shadow") | ~F.col("_gold")),
        "gate_eligible": F.col("_base") & (F.col("_status") == "active") & F.col("_gold"),
    }).drop("_status", "_gold", "_base", "_review")


def with_behaviour(cases: DataFrame) -> DataFrame:
    """Expected behaviour and task type; what the case names itself stands (P8, P9). ``tool_calls`` counts expected calls."""
    tools = F.coalesce(F.col("tool_calls"), F.lit(0)) > 0
    wants_json = F.coalesce(F.lower(field(cases, "expected_format")).startswith("json"), F.lit(False))
    behaviour = F.coalesce(field(cases, "expected_behavior"), F.when(tools, "tool_call_then_grounded_answer").when(wants_json, "structured_output_required"), F.lit(""))
    out = cases.withColumn("expected_behavior", behaviour)
    task = F.when(tools, "tool_agent")
    for name, behaviours in TASKS.items():
        task = task.when(F.col("expected_behavior").isin(*behaviours), name)
    return out.withColumn("task_type", task.otherwise(F.coalesce(field(cases, "question_type"), F.lit("grounded_qa"))))


def compact_topic(path: Column) -> Column:
    """The last two parts of ``a > b > c``."""
    parts = F.filter(F.transform(F.split(path, ">"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), " > ")).otherwise(F.trim(path))


def run_type(cases: DataFrame) -> DataFrame:
    """What kind of run each pool of cases with a lifecycle makes."""
    benchmark = F.bool_and(F.coalesce(F.lower(field(cases, "dataset_role")), F.lit("")).isin("benchmark", "")) & F.bool_or(F.coalesce(F.lower(field(cases, "dataset_role")) == "benchmark", F.lit(False)))
    kind = F.when(F.bool_or("gate_eligible"), "release_gate").when(benchmark, "benchmark").when(F.bool_or(F.col("case_status").isin("draft", "shadow")), "exploratory_regression").otherwise("not_applicable")
    return cases.groupBy("pool_id").agg(F.count("*").alias("cases"), F.count_if("gate_eligible").alias("gate_eligible_cases"), kind.alias("run_type"))


def in_pool(cases: DataFrame, include: dict[str, list[str]], exclude: dict[str, list[str]] | None = None) -> DataFrame:
    """Cases that match every field of ``include`` and none of ``exclude``; a list matches on any overlap (F1, F2)."""

    def hit(name: str, values: list[str]) -> Column:
        kind = dict(cases.dtypes).get(name, "string")
        held = F.col(name).cast("array<string>") if kind.startswith("array") else F.array(field(cases, name))
        return F.coalesce(F.arrays_overlap(F.array_compact(held), F.array(*map(F.lit, values))), F.lit(False))

    for name, values in include.items():
        cases = cases.where(hit(name, values))
    for name, values in (exclude or {}).items():
        cases = cases.where(~hit(name, values))
    return cases


def with_status(cases: DataFrame, status: str = "active") -> DataFrame:
    """Cases of a status; a pool that has no active ones gives its shadow ones instead (F3). One aggregation on the pool."""
    if status != "active":
        return cases.where(F.col("case_status") == status)
    # one small row for each pool
    bare = cases.groupBy("pool_id").agg(F.bool_or(F.col("case_status") == "active").alias("_has")).where("not _has").select("pool_id")
    shadow = cases.where("case_status = 'shadow'").join(bare, "pool_id", "left_semi")
    return cases.where("case_status = 'active'").unionByName(shadow)
