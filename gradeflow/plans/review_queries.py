"""Queries of review queues, hits, ordered lists, labels and composition, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import compose, review
from gradeflow.plans import fixtures as fx
from gradeflow.plans.queries import _CASES, _CONSENSUS, _s, query, rounded
from gradeflow.plans.view_queries import _BAD, _ROWS, rows
from gradeflow.sources import files

_FULL = f"""{_ROWS}, fl AS (SELECT w.*, k.gold_verified, k.gate_eligible, CASE WHEN k.active THEN 'active' ELSE 'shadow' END AS case_status, NOT k.gold_verified AND w.case_id % 2 = 0 AS human_review_required, CASE WHEN w.case_id % 19 = 0 THEN 'error' ELSE 'ok' END AS judge_status, release_gate = 'review' AND w.case_id % 3 = 0 AS unresolved,
  CASE w.case_id % 4 WHEN 0 THEN 'benchmark' WHEN 1 THEN 'regression' END AS dataset_role, 'src' || (w.case_id % 7) || CASE WHEN w.case_id % 7 = 2 THEN '-Golden' ELSE '' END AS dataset_pool_id, round(w.overall, 6) AS o FROM w JOIN k USING (case_id)),
rq AS (SELECT *, CASE WHEN release_gate = 'block' OR error_type IN ('unsafe_completion', 'hallucinated_policy') THEN 0 WHEN unresolved OR {_BAD} OR judge_status = 'error' THEN 1 ELSE 2 END AS priority,
  CASE WHEN NOT gold_verified THEN 'approve or mend the gold answer' WHEN unresolved THEN 'review with the arbiter' WHEN judge_status = 'error' THEN 'judge again' WHEN {_BAD} THEN 'find the cause' ELSE 'approve' END AS action FROM fl WHERE human_review_required OR NOT gold_verified OR judge_status = 'error' OR unresolved),
ex AS (SELECT *, NOT contains(lower(coalesce(dataset_role, '') || ' ' || dataset_pool_id), 'regression') AND NOT contains(lower(dataset_pool_id), 'golden') AND coalesce(dataset_role, '') = 'benchmark' AS is_benchmark FROM fl WHERE case_status = 'shadow' OR human_review_required OR NOT gate_eligible)"""


def full_rows(spark, d):
    known = fx.cases(spark, d).select("case_id", "gold_verified", "gate_eligible", "active")
    out = rounded(rows(spark, d).join(known, "case_id"), "overall")
    i = F.col("case_id")
    return out.withColumns({"case_status": F.when(F.col("active"), "active").otherwise("shadow"), "human_review_required": ~F.col("gold_verified") & (i % 2 == 0), "judge_status": F.when(i % 19 == 0, "error").otherwise("ok"), "unresolved": (F.col("release_gate") == "review") & (i % 3 == 0), "release_gate_eligible": F.col("gate_eligible"), "dataset_role": F.when(i % 4 == 0, "benchmark").when(i % 4 == 1, "regression"), "dataset_pool_id": F.concat(F.lit("src"), i % 7, F.when(i % 7 == 2, "-Golden").otherwise("")), "dataset_version": F.lit("v1"), "benchmark_group": F.lit("unknown")})


@query(f"WITH {_FULL} SELECT config_id, case_id, priority, action FROM rq ORDER BY priority, o, config_id, case_id LIMIT 160")
def review_queue(spark, d):
    """K3, P36."""
    return review.review_queue(full_rows(spark, d)).select("config_id", "case_id", "priority", "action")


@query(f"WITH {_FULL} SELECT count(DISTINCT case_id) AS cases, count(*) FILTER (WHERE priority = 0) AS high, count(*) FILTER (WHERE NOT gold_verified) AS unverified, count(*) FILTER (WHERE judge_status = 'error') AS judge_errors, count(*) FILTER (WHERE unresolved) AS unresolved FROM rq")
def review_kpis(spark, d):
    """A33, P36."""
    return review.review_kpis(full_rows(spark, d))


@query(f"WITH {_FULL} SELECT config_id, case_id, human_review_required FROM ex ORDER BY human_review_required DESC, o, config_id, case_id LIMIT 120")
def exploratory_rows(spark, d):
    """K5, F11."""
    return review.exploratory_rows(full_rows(spark, d)).select("config_id", "case_id", "human_review_required")


@query(f"WITH {_FULL} SELECT count(DISTINCT case_id) AS cases, count(*) FILTER (WHERE is_benchmark) AS benchmark, count(*) FILTER (WHERE case_status = 'shadow') AS shadow, count(*) FILTER (WHERE human_review_required) AS review, round(avg(o), 6) AS average FROM ex")
def exploratory_kpis(spark, d):
    """A33, P37."""
    return rounded(review.exploratory_kpis(full_rows(spark, d)), "average")


@query(f"WITH {_FULL} SELECT config_id, case_id FROM fl WHERE contains(lower(concat_ws(chr(1), question_type, error_type)), 'inaccuracy') ORDER BY {_BAD} DESC, o, config_id, case_id LIMIT 120")
def search_hits(spark, d):
    """K4, F6."""
    from gradeflow.operators.views import searched

    return review.search_hits(searched(full_rows(spark, d), "Inaccuracy", ["question_type", "error_type"])).select("config_id", "case_id")


#: Parts stand for models, orders for runs, suppliers for datasets.
_MODELS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Llama_3-' WHEN 1 THEN 'qwen2:' WHEN 2 THEN 'DeepSeek-r1-' WHEN 3 THEN 'own ' WHEN 4 THEN 'clova/' ELSE 'base_gemma2_' END || CASE WHEN p_partkey % 5 = 0 THEN 'it' ELSE (p_partkey % 70) || 'b' END || CASE p_partkey % 3 WHEN 0 THEN '_q4_k_m' WHEN 1 THEN '-Q8' ELSE '' END AS name FROM part"


@query(f"SELECT id, name, CASE id % 6 WHEN 0 THEN 'llama' WHEN 1 THEN 'qwen' WHEN 2 THEN 'deepseek' WHEN 3 THEN 'other' WHEN 4 THEN 'hcx' ELSE 'gemma' END AS family, CASE WHEN id % 5 > 0 THEN (id % 70)::DOUBLE END AS billions, CASE id % 3 WHEN 0 THEN 'Q4-K-M' WHEN 1 THEN 'Q8' END AS quantisation FROM ({_MODELS})")
def models_in_order(spark, d):
    """P38, K12."""
    return review.models_in_order(fx.frame(spark, d, _MODELS), "name").select("id", "name", "family", "billions", "quantisation")


_RUNS = "SELECT '' || o_orderkey AS run_id, CASE WHEN o_orderkey % 9 = 0 THEN 'smoke ' ELSE 'run ' END || o_custkey AS name, CASE o_orderkey % 4 WHEN 0 THEN 'data\\\\QuestionList' WHEN 1 THEN 'data\\\\questionlist\\\\final_sets\\\\a.csv' WHEN 2 THEN 'questionlist/benchmark/b.csv' ELSE NULL END AS case_source, o_orderdate AS started_at FROM orders"


@query("SELECT '' || o_orderkey AS run_id, o_orderdate AS started_at FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 4 IN (1, 2)")
def final_runs(spark, d):
    """F9, K11."""
    return review.final_runs(fx.frame(spark, d, _RUNS)).select("run_id", "started_at")


_SETS = "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'final_' ELSE 'set_' END || s_suppkey AS dataset_id, CASE s_suppkey % 3 WHEN 0 THEN 'benchmark' WHEN 1 THEN 'regression' ELSE 'mixed' END AS role, CASE s_suppkey % 8 WHEN 0 THEN 'lists/Archive/x.csv' WHEN 1 THEN 'lists/old-x.csv' WHEN 2 THEN 'lists/gold.csv' ELSE 'lists/x.csv' END AS path, s_suppkey % 4 AS total, s_suppkey % 2 = 0 AS discovered FROM supplier"


@query(f"WITH s AS ({_SETS}) SELECT dataset_id, CASE WHEN starts_with(dataset_id, 'final_') AND role = 'benchmark' THEN 0 WHEN starts_with(dataset_id, 'final_') AND role = 'regression' THEN 1 WHEN discovered AND role = 'benchmark' THEN 30 WHEN discovered THEN 40 WHEN role = 'benchmark' THEN 10 WHEN role = 'regression' THEN 20 ELSE 50 END AS rank FROM s WHERE total > 0 AND path NOT IN ('lists/Archive/x.csv', 'lists/old-x.csv')")
def datasets_in_order(spark, d):
    """K14, S10."""
    return review.datasets_in_order(fx.frame(spark, d, _SETS), "final_").select("dataset_id", "rank")


@query(f"WITH {_CONSENSUS} SELECT DISTINCT case_id FROM s ORDER BY case_id LIMIT 200")
def question_list(spark, d):
    """K13."""
    return review.question_list(_s(spark, d))


@query(f"WITH {_CONSENSUS} SELECT config_id, case_id, judges AS score_judges FROM s WHERE case_id % 5 > 0")
def outputs_with_score_columns(spark, d):
    """Answers of the given keys beside their scores."""
    s = _s(spark, d)
    wanted = s.where("case_id % 5 > 0").select("config_id", "case_id")
    return review.with_score_columns(review.of_keys(s, wanted.unionByName(wanted)).select("config_id", "case_id"), s.select("config_id", "case_id", "judges"))


@query(f"WITH {_CONSENSUS} SELECT config_id, case_id, round(overall, 6) AS overall, pass FROM s WHERE case_id = 7 AND config_id = 'm2'")
def case_detail(spark, d):
    """J20."""
    return rounded(review.case_detail(_s(spark, d), 7, "m2").select("config_id", "case_id", "overall", "pass"), "overall")


@query("SELECT l_returnflag AS profile_id, sum(l_linenumber)::BIGINT AS total, count(*) AS pools FROM lineitem GROUP BY 1")
def profile_totals(spark, d):
    """Return flags stand for profiles, line numbers for quotas."""
    return review.quota_totals(fx.frame(spark, d, "SELECT l_returnflag AS profile_id, CAST(l_linenumber AS LONG) AS quota FROM lineitem"))


_REASONS = f"SELECT config_id, case_id, judge_id, CASE seq WHEN 0 THEN 'Multi-Judge aggregation : ' || error_type WHEN 1 THEN 'mean across judge apis. judge  pass/fail disagreement; Judge pass/fail disagreement' ELSE 'x ' || error_type || chr(10) || ' unsafe_completion' END AS reason FROM ({fx.VERDICTS_SQL})"


@query(f"SELECT config_id, case_id, judge_id, CASE judge_id WHEN 'j0' THEN '여러 Judge 집계: ' || e WHEN 'j1' THEN '여러 Judge 평균입니다. judge pass/fail disagreement; Judge 통과/실패 판단 불일치' ELSE 'x ' || e || ' 위험 응답' END AS reason FROM (SELECT *, CASE error_type WHEN 'partial_inaccuracy' THEN '부분적 부정확' WHEN 'unsupported_claim' THEN '근거 없는 주장' ELSE error_type END AS e FROM ({fx.VERDICTS_SQL}))")
def reasons_shown(spark, d):
    """P51."""
    return fx.frame(spark, d, _REASONS).select("config_id", "case_id", "judge_id", review.reason_text(F.col("reason")).alias("reason"))


_RAW_ROWS = "SELECT l_orderkey AS id, l_linenumber AS n, CASE l_orderkey % 4 WHEN 0 THEN '85' WHEN 1 THEN '0.4' WHEN 2 THEN 'x' END AS overall, CASE l_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'm1' END AS model, CASE l_linenumber % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'off' ELSE 'maybe' END AS gold_verified, CASE l_linenumber % 4 WHEN 0 THEN 'Incomplete-Information' WHEN 1 THEN '' WHEN 2 THEN 'strange' ELSE 'typo' END AS error_type FROM lineitem"


@query(f"SELECT id, n, CASE overall WHEN '85' THEN 0.85::DOUBLE WHEN '0.4' THEN 0.4 ELSE 0 END AS overall, coalesce(nullif(trim(model), ''), 'unknown') AS model, gold_verified = 'YES' AS gold_verified, CASE error_type WHEN 'Incomplete-Information' THEN 'missing_condition' WHEN '' THEN 'normal' ELSE 'partial_inaccuracy' END AS error_type FROM ({_RAW_ROWS})")
def rows_cleaned(spark, d):
    """P50, P13, P14."""
    return review.cleaned_rows(fx.frame(spark, d, _RAW_ROWS), ["overall"], ["model"], ["gold_verified"])


_INVENTORY = "SELECT '' || l_suppkey AS run_id, count(*) AS rows, sum(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS usable, max(l_shipdate) AS updated_at FROM lineitem GROUP BY l_suppkey"


@query(f"SELECT run_id, usable::BIGINT AS usable, updated_at FROM ({_INVENTORY}) WHERE usable > 0")
def judge_sources_in_order(spark, d):
    """Suppliers stand for judge runs."""
    return review.judge_sources(fx.frame(spark, d, _INVENTORY)).select("run_id", "usable", "updated_at")


# composition

_POOLED = """SELECT 'p' || (d.doc_id % 3) AS pool_id, CASE WHEN d.doc_id % 4 = 0 THEN '' || (d.doc_id - d.doc_id % 8) ELSE '' || d.doc_id END AS case_id, d.doc_id AS ordinal, d.source, d.lang, CASE WHEN l.doc_id IS NULL THEN 'shadow' ELSE 'active' END AS case_status, coalesce(l.quality, 0) = 1 AS gold_verified FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
_ORDER = "sha256('s:' || {p} || ':' || case_id)"


@query(f"""WITH c AS ({_POOLED}), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY pool_id, case_id ORDER BY ordinal) = 1),
p0 AS (SELECT * FROM f WHERE pool_id = 'p0' AND case_status = 'active' ORDER BY {_ORDER.format(p="pool_id")}, case_id LIMIT 10),
p1 AS (SELECT * FROM f WHERE pool_id = 'p1' AND case_status = 'active' AND case_id NOT IN (SELECT case_id FROM p0) ORDER BY {_ORDER.format(p="pool_id")}, case_id LIMIT 12),
p2 AS (SELECT * FROM f WHERE pool_id = 'p2' AND case_status = 'active' AND case_id NOT IN (SELECT case_id FROM p0 UNION ALL SELECT case_id FROM p1) ORDER BY {_ORDER.format(p="pool_id")}, case_id LIMIT 8),
u AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT pool_id, CASE pool_id WHEN 'p0' THEN 'B::' || case_id ELSE case_id END AS case_id, CASE pool_id WHEN 'p0' THEN 'benchmark' ELSE 'regression' END AS dataset_role, pool_id <> 'p0' AND gold_verified AS gate_eligible, NOT gold_verified AS human_review_required FROM u""")
def composed_set(spark, d):
    """Three pools in order; a case taken by an earlier pool is passed over by later ones."""
    return compose.composed(fx.frame(spark, d, _POOLED), compose_pools(), seed="s").select("pool_id", "case_id", "dataset_role", "gate_eligible", "human_review_required")


def compose_pools() -> list[compose.Pool]:
    return [compose.Pool("p0", 10, role="benchmark", prefix="B"), compose.Pool("p1", 12), compose.Pool("p2", 8)]


@query(f"""WITH c AS ({_POOLED}), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY pool_id, case_id ORDER BY ordinal) = 1), q(pool_id, n, k) AS (VALUES ('p0', 10, 0), ('p1', 12, 1), ('p2', 8, 2))
SELECT 'selected' AS figure, pool_id AS value, n::BIGINT AS n FROM q UNION ALL SELECT 'role', CASE pool_id WHEN 'p0' THEN 'benchmark' ELSE 'regression' END, sum(n)::BIGINT FROM q GROUP BY 2 UNION ALL SELECT 'status', 'active', 30""")
def compose_summary(spark, d):
    """How many each pool gave, and by role and status."""
    return compose.summary(compose.composed(fx.frame(spark, d, _POOLED), compose_pools(), seed="s")).where("figure <> 'gate'")


@query(f"WITH c AS ({_POOLED}) SELECT case_id, arg_min(pool_id, struct_pack(p := pool_id, o := ordinal)) AS pool_id FROM c GROUP BY 1")
def first_pool_wins(spark, d):
    """W3, U1."""
    c = fx.frame(spark, d, _POOLED).withColumn("pool_order", F.col("pool_id"))
    return compose.first_wins(c).select("case_id", "pool_id")


@query("WITH p AS (SELECT p_brand AS pool_id, count(*)::DOUBLE AS weight, min(p_partkey) AS position FROM part GROUP BY 1), s AS (SELECT *, weight / sum(weight) OVER () * 40 AS x FROM p), r AS (SELECT *, floor(x)::BIGINT AS b, row_number() OVER (ORDER BY x - floor(x) DESC, weight DESC, position) AS k FROM s) SELECT pool_id, quota FROM (SELECT pool_id, b + (k <= 40 - (SELECT sum(b) FROM r))::INT AS quota FROM r) WHERE quota > 0")
def quotas_by_weight(spark, d):
    """Brands stand for pools."""
    pools = fx.frame(spark, d, "SELECT p_brand AS pool_id, CAST(count(*) AS DOUBLE) AS weight, min(p_partkey) AS position FROM part GROUP BY p_brand")
    return compose.allotted(pools, 40).select("pool_id", "quota")


@query("""SELECT doc_id, CASE WHEN contains(t, 'sensitive') OR contains(t, '민감') THEN '민감' WHEN contains(t, 'numeric') OR contains(t, 'numerical') OR contains(t, 'calculation') OR contains(t, '수치') OR contains(t, '계산') THEN '수치추론/계산' WHEN contains(t, 'multi-hop') OR contains(t, 'multihop') OR contains(t, 'multi hop') OR contains(t, '복합') THEN '복합추론' WHEN contains(t, 'compar') OR contains(t, '비교') OR contains(t, '대조') THEN '비교대조' WHEN contains(t, 'single') OR contains(t, 'fact') OR contains(t, '단일') OR contains(t, '사실') THEN '단일추론(사실추출)' ELSE coalesce(nullif(trim(k), ''), '단일추론(사실추출)') END AS question_type
FROM (SELECT doc_id, k, lower(k || ' ' || coalesce(source, '')) AS t FROM (SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN 'Numeric' WHEN 1 THEN 'a Multi hop one' WHEN 2 THEN 'comparison' WHEN 3 THEN '민감 정보' WHEN 4 THEN '' WHEN 5 THEN 'own kind' ELSE 'FACT' END AS k FROM documents))""")
def question_types_named(spark, d):
    """P10."""
    df = fx.frame(spark, d, "SELECT doc_id, coalesce(source, '') AS source, CASE doc_id % 7 WHEN 0 THEN 'Numeric' WHEN 1 THEN 'a Multi hop one' WHEN 2 THEN 'comparison' WHEN 3 THEN '민감 정보' WHEN 4 THEN '' WHEN 5 THEN 'own kind' ELSE 'FACT' END AS k FROM documents")
    return df.select("doc_id", compose.labelled([F.col("k"), F.col("source")], compose.QUESTION_TYPES, own=F.col("k")).alias("question_type"))


@query(f"WITH {_CONSENSUS}, gv(config_id, k) AS (VALUES ('m3', 0), ('m1', 1)) SELECT s.config_id, case_id, k AS config_place, CASE WHEN case_id % 2 = 0 THEN -case_id END AS case_place FROM s LEFT JOIN gv ON gv.config_id = s.config_id")
def rows_in_given_order(spark, d):
    """Given models first and in their order, unknown ones last; even cases from the last one."""
    s = _s(spark, d).select("config_id", "case_id")
    cases = fx.cases(spark, d).where("case_id % 2 = 0").select("case_id", (-F.col("case_id")).alias("position"))
    return compose.in_order(s, spark.createDataFrame([("m3", 0), ("m1", 1)], "config_id string, position int"), cases)


@query("SELECT l_partkey AS version, arg_min(l_returnflag, struct_pack(a := l_orderkey, b := l_linenumber)) FILTER (WHERE l_returnflag <> 'N') AS model FROM lineitem GROUP BY 1")
def first_names(spark, d):
    """Parts stand for versions; the first name that is not empty."""
    rows_ = fx.frame(spark, d, "SELECT l_partkey AS version, nullif(l_returnflag, 'N') AS model, l_orderkey, l_linenumber FROM lineitem")
    return compose.first_named(rows_, "version", "model", F.struct("l_orderkey", "l_linenumber"))


@query(f"WITH {_CASES} SELECT case_id, 'ext' AS config_id, 'Ext model' AS display_name, '' AS model_answer, 'ok' AS status FROM k ORDER BY case_id LIMIT 150")
def answers_template(spark, d):
    """S24."""
    return files.answers_template(fx.cases(spark, d).select("case_id"), "ext", display_name="Ext model", most=150).select("case_id", "config_id", "display_name", "model_answer", "status")


@query(f"SELECT config_id, case_id, judge_id, seq, accuracy FROM ({fx.VERDICTS_SQL})")
def embedded_verdicts_exploded(spark, d):
    """Verdicts as a JSON list in a column, and back."""
    v = fx.verdicts(spark, d)
    packed = v.groupBy("config_id", "case_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "judge_id", "accuracy")))).alias("individual"))
    return files.exploded_verdicts(packed, "individual", "seq int, judge_id string, accuracy int").select("config_id", "case_id", "judge_id", "seq", "accuracy")


@query("SELECT o_custkey AS case_id, o_orderstatus AS config_id, max(o_orderkey) AS seq FROM orders GROUP BY ALL")
def checkpoint_last_rows(spark, d):
    """Customers and states stand for cases and models, orders for lines of a checkpoint."""
    rows_ = fx.frame(spark, d, "SELECT o_custkey AS case_id, o_orderstatus AS config_id, o_orderkey AS seq FROM orders")
    return files.last_rows(rows_, ["config_id", "case_id"], "seq").select("case_id", "config_id", "seq")


