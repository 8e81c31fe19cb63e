"""Review queues, search hits, ordered lists and labels of views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.columns import error_type, parse_bool, score01
from gradeflow.operators.views import BY_SCORE, failing, gate_rank, page_after

# Marks of regression cases and of runs that don't count, folders that hold no datasets, families of models.
REGRESSION_MARKS = ("regression", "golden", "hard_negative", "hardnegative", "edge_case", "edgecase")
RUN_MARKS = ("SMOKE", "DEBUG", "TEST")
FINAL_SETS = ("questionlist/final_sets/", "questionlist/benchmark/", "questionlist/regression/", "benchmark_final_full", "regression_golden_full")
DATASET_MARKS = ("_unused_files", "archive", "backup", "tmp", "draft", "cleanup")
DATASET_TOKENS = ("old",)
FAMILIES = {"deepseek": ("deepseek", "deep seek"), "gemma": ("gemma",), "llama": ("llama",), "qwen": ("qwen",), "exaone": ("exaone",), "hcx": ("hcx", "clova"), "gpt": ("gpt", "openai")}
#: Phrases of reasons and what they are shown as, in order.
PHRASES = (
    (r"(?i)^Single LLM Judge scoring\s*:", "단일 Judge 채점:"),
    (r"(?i)^Multi-Judge aggregation\s*:", "여러 Judge 집계:"),
    (r"^LLM Judge 단독 채점\s*:", "단일 Judge 채점:"),
    (r"(?i)Trimmed mean across judge APIs; highest and lowest metric scores are excluded when three or more judges are present\.?", "여러 Judge 중 최고/최저 지표 점수를 제외한 평균입니다."),
    (r"(?i)Mean across judge APIs\.?", "여러 Judge 평균입니다."),
    (r"(?i)judge error-type disagreement", "Judge 오류 유형 불일치"),
    (r"(?i)judge pass/fail disagreement", "Judge 통과/실패 판단 불일치"),
    (r"(?i)judge pass decision disagreement", "Judge 통과/실패 판단 불일치"),
    (r"(?i)partial_inaccuracy", "부분적 부정확"),
    (r"(?i)unsupported_claim", "근거 없는 주장"),
    (r"(?i)missing_condition", "필수 조건 누락"),
    (r"(?i)hallucinated_policy", "정책 환각"),
    (r"(?i)unsafe_completion", "위험 응답"),
    (r"(?i)format_violation", "형식 위반"),
)


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def review_priority() -> Column:
    """0 for what blocks, 1 for conflicts, failures and judge errors, 2 for the rest."""
    high = (F.col("release_gate") == "block") | F.col("error_type").isin("unsafe_completion", "hallucinated_policy")
    return F.when(high, 0).when(F.col("unresolved") | failing() | (F.col("judge_status") == "error"), 1).otherwise(2)


def suggested_action() -> Column:
    """What a reviewer should do."""
    return F.when(~F.col("gold_verified"), "approve or mend the gold answer").when(F.col("unresolved"), "review with the arbiter").when(F.col("judge_status") == "error", "judge again").when(failing(), "find the cause").otherwise("approve")


def in_review() -> Column:
    return F.col("human_review_required") | ~F.col("gold_verified") | (F.col("judge_status") == "error") | F.col("unresolved")


def review_queue(rows: DataFrame, most: int = 160) -> DataFrame:
    """What people should look at, by priority, then score (K3)."""
    return rows.where(in_review()).withColumns({"priority": review_priority(), "action": suggested_action()}).orderBy("priority", "overall", "config_id", "case_id").limit(most)


def review_kpis(rows: DataFrame) -> DataFrame:
    """Cases under review, rows of high priority, unverified, with judge errors, in open conflict."""
    return rows.where(in_review()).agg(F.count_distinct("case_id").alias("cases"), F.count_if(review_priority() == 0).alias("high"), F.count_if(~F.col("gold_verified")).alias("unverified"), F.count_if(F.col("judge_status") == "error").alias("judge_errors"), F.count_if("unresolved").alias("unresolved"))


def exploratory() -> Column:
    """Rows that never block a release."""
    return F.col("case_status").isin("draft", "shadow") | F.col("human_review_required") | (F.col("release_gate") == "not_applicable") | ~F.col("gate_eligible") | ~F.col("release_gate_eligible")


REVIEW_FIRST = (("human_review_required", True), *BY_SCORE)


def exploratory_rows(rows: DataFrame, most: int = 120, after: dict | None = None) -> DataFrame:
    """Those under review first, then by score; a page after a key if one is given (K5)."""
    return page_after(rows.where(exploratory()), REVIEW_FIRST, after, most)


def exploratory_kpis(rows: DataFrame) -> DataFrame:
    """Cases, benchmark, shadow and review rows and mean score of the exploratory rows."""
    return rows.where(exploratory()).agg(F.count_distinct("case_id").alias("cases"), F.count_if(is_benchmark()).alias("benchmark"), F.count_if(F.col("case_status") == "shadow").alias("shadow"), F.count_if("human_review_required").alias("review"), F.avg("overall").alias("average"))


def is_benchmark() -> Column:
    """Benchmark rows: by role, group or marks; whatever is marked as regression is none."""
    marks = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("dataset_role", "dataset_pool_id", "dataset_version", "benchmark_group", "case_id")]))
    known = (F.coalesce("dataset_role", F.lit("")) == "benchmark") | (F.coalesce("benchmark_group", F.lit("unknown")) != "unknown") | marks.contains("benchmark")
    return ~_any(marks, REGRESSION_MARKS) & known


FAILURES_FIRST = (("failing", True), *BY_SCORE)


def search_hits(found: DataFrame, most: int = 120, after: dict | None = None) -> DataFrame:
    """Failures first, then by score; a page after a key if one is given (K4)."""
    return page_after(found.withColumn("failing", failing()), FAILURES_FIRST, after, most)


def model_info(name: Column) -> dict[str, Column]:
    """Family with its place, parameters in billions and quantisation, as a model's name tells them (P38); null and last where it does not."""
    low = F.lower(F.coalesce(name, F.lit("")))
    family, place = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for k, (f, marks) in enumerate(FAMILIES.items()):
        family, place = family.when(_any(low, marks), f), place.when(_any(low, marks), k)
    size = F.nullif(F.regexp_extract(F.regexp_replace(low, "[_:/-]+", " "), r"\b(\d+(?:\.\d+)?)\s*b\b", 1), F.lit(""))
    quant = F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?i)(?:^|[\s_:/-])(q\d[a-z0-9_]*)(?=$|[\s_:/-])", 1), F.lit(""))
    return {"family": family.otherwise("other"), "family_place": place.otherwise(len(FAMILIES)), "billions": size.cast("double"), "quantisation": F.upper(F.replace(quant, F.lit("_"), F.lit("-")))}


def models_in_order(models: DataFrame, name: str) -> DataFrame:
    """By family, size, name (K12); unknown sizes last."""
    return models.withColumns(model_info(F.col(name))).orderBy("family_place", F.col("billions").asc_nulls_last(), name)


def slices_in_order(slices: DataFrame) -> DataFrame:
    """By model, number of dimensions, reliable ones first, count, then names."""
    level = F.size(F.split("dimension", " x "))
    return slices.withColumn("level", level).orderBy("config_id", "level", F.when(F.col("reliability") == "reliable", 0).otherwise(1), F.desc("case_count"), "dimension", "value")


def final_runs(runs: DataFrame) -> DataFrame:
    """Runs over the final question sets, no smoke, debug or test runs (F9), newest first."""
    named = _any(F.upper(F.concat_ws(" ", "name", "run_id")), RUN_MARKS)
    source = F.replace(F.coalesce("case_source", F.lit("")), F.lit("\\"), F.lit("/"))
    return runs.where(~named & _any(source, FINAL_SETS)).orderBy(F.desc("started_at"), "run_id")


def question_list(rows: DataFrame, most: int = 200) -> DataFrame:
    """The first distinct questions by id."""
    return rows.select("case_id").distinct().orderBy("case_id").limit(most)


def dataset_path_excluded(path: Column) -> Column:
    """Paths with a mark in any part, or an old one by name."""
    low = F.lower(path)
    return _any(low, DATASET_MARKS) | F.arrays_overlap(F.split(low, "[^a-z0-9]+"), F.array(*[F.lit(t) for t in DATASET_TOKENS]))


def datasets_in_order(datasets: DataFrame, default: str) -> DataFrame:
    """Datasets that can be chosen: there, not empty, not excluded; defaults first, then by role and how they were found."""
    own, role = F.col("dataset_id").startswith(default), F.col("role")
    found = F.coalesce("discovered", F.lit(False))
    rank = F.when(own & (role == "benchmark"), 0).when(own & (role == "regression"), 1).when(found & (role == "benchmark"), 30).when(found, 40).when(role == "benchmark", 10).when(role == "regression", 20).otherwise(50)
    chosen = datasets.where((F.coalesce("total", F.lit(0)) > 0) & ~dataset_path_excluded(F.col("path")))
    return chosen.withColumn("rank", rank).orderBy("rank", "dataset_id")


def judge_sources(inventory: DataFrame) -> DataFrame:
    """Judge runs with usable rows, the most first, then the newest."""
    return inventory.where("usable > 0").orderBy(F.desc("usable"), F.desc("updated_at"), "run_id")


def quota_totals(quotas: DataFrame) -> DataFrame:
    """Size of each profile: the sum of its pools' quotas."""
    return quotas.groupBy("profile_id").agg(F.sum("quota").alias("total"), F.count("*").alias("pools"))


def reason_text(c: Column) -> Column:
    """A reason in the words that people see, points as scores from 0 to 1."""
    out = F.coalesce(c, F.lit(""))
    for pattern, words in PHRASES:
        out = F.regexp_replace(out, pattern, words)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def cleaned_rows(rows: DataFrame, numbers: list[str], texts: list[str], flags: list[str]) -> DataFrame:
    """Rows as views take them: numbers or 0, texts or ``unknown``, booleans from text, scores from 0 to 1, canonical error types (P50)."""
    out = rows.withColumns({c: F.coalesce(score01(F.col(c)), F.lit(0.0)) for c in numbers})
    out = out.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown")) for c in texts})
    out = out.withColumns({c: F.coalesce(parse_bool(F.col(c)), F.lit(False)) for c in flags})
    return out.withColumn("error_type", error_type(F.col("error_type"))) if "error_type" in rows.columns else out


def with_score_columns(outputs: DataFrame, scores: DataFrame, prefix: str = "score_") -> DataFrame:
    """A model's answers with its scores beside them under prefixed names."""
    key = ["config_id", "case_id"]
    return outputs.join(scores.select(*key, *[F.col(c).alias(prefix + c) for c in scores.columns if c not in key]), key, "left")


def of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose answer is among the keys."""
    return rows.join(keys.select("config_id", "case_id").distinct(), ["config_id", "case_id"], "left_semi")


def case_detail(rows: DataFrame, case_id: object, config_id: str) -> DataFrame:
    """The row of one case and model."""
    return rows.where((F.col("case_id") == F.lit(case_id)) & (F.col("config_id") == config_id))


def not_catalogued(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Discovered datasets whose path no catalogue entry has."""
    return found.join(catalogue.select("path").distinct(), "path", "left_anti")


def gates_in_order(gates: DataFrame) -> DataFrame:
    """The gate table by gate, the worst first, then model (K7)."""
    return gates.orderBy(gate_rank(F.col("release_gate")), "config_id")
