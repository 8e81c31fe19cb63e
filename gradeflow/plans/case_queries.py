"""Queries over raw cases, applied scores, wide facts and reuse, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions.columns import squeezed
from gradeflow.operators import apply, cases, facts, judges
from gradeflow.plans import fixtures as fx
from gradeflow.plans.queries import WS, _CONSENSUS, _NORMAL, _s, _v, query, rounded

#: Cases as they come: mixed capitals, blanks and unknown words; every second one keeps its role and gold mark in metadata.
RAW_SQL = """
SELECT d.doc_id AS case_id, d.source AS pool_id, d.lang AS question_type,
  CASE d.doc_id % 7 WHEN 0 THEN 'Draft' WHEN 1 THEN ' ' WHEN 2 THEN 'active' WHEN 3 THEN 'odd' END AS case_status,
  CASE d.doc_id % 5 WHEN 0 THEN 'generated' WHEN 1 THEN 'Active ' WHEN 2 THEN 'shadow' WHEN 3 THEN 'active' END AS status,
  CASE d.doc_id % 3 WHEN 0 THEN 'Benchmark' WHEN 1 THEN 'regression' END AS dataset_role,
  CASE l.quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'off' END AS gold_verified,
  CASE d.doc_id % 11 WHEN 0 THEN 'true' WHEN 1 THEN 'maybe' WHEN 2 THEN '0' END AS human_review_required,
  CASE d.doc_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN '1' END AS gate_eligible,
  CASE d.doc_id % 13 WHEN 0 THEN 'false' END AS release_gate_eligible,
  CASE d.doc_id % 17 WHEN 0 THEN 'true' END AS deprecated,
  CASE d.doc_id % 6 WHEN 0 THEN 'refuse_unsafe_request' WHEN 1 THEN ' ' WHEN 2 THEN 'ask_clarifying_question' END AS expected_behavior,
  CASE d.doc_id % 8 WHEN 3 THEN 'JSON object' END AS expected_format,
  CASE WHEN d.doc_id % 9 = 4 THEN 2 ELSE 0 END AS tool_calls
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
_BOOL = lambda c: f"CASE WHEN lower(trim({c})) IN ('1', 'true', 'yes', 'y', 'on') THEN true WHEN lower(trim({c})) IN ('0', 'false', 'no', 'n', 'off') THEN false END"
_LIFE = f"""r AS ({RAW_SQL}),
t AS (SELECT *, lower(nullif(trim(case_status), '')) AS cs, lower(nullif(trim(status), '')) AS ss, coalesce({_BOOL('gold_verified')}, false) AS gold,
  coalesce({_BOOL('gate_eligible')}, coalesce(lower(dataset_role), '') <> 'benchmark') AND coalesce({_BOOL('release_gate_eligible')}, true) AND NOT coalesce({_BOOL('deprecated')}, false) AS base, {_BOOL('human_review_required')} AS review FROM r),
u AS (SELECT *, CASE WHEN cs IN ('draft', 'shadow', 'active', 'deprecated') THEN cs WHEN ss IN ('shadow', 'draft', 'deprecated') THEN ss WHEN ss IN ('candidate', 'generated') THEN 'draft' WHEN ss = 'active' AND gold THEN 'active' ELSE 'shadow' END AS state FROM t),
life AS (SELECT case_id, pool_id, dataset_role, state AS case_status, gold AS gold_verified, coalesce(review, state IN ('draft', 'shadow') OR NOT gold) AS human_review_required, base AND state = 'active' AND gold AS gate_eligible FROM u)"""


def raw(spark, d):
    out = fx.frame(spark, d, RAW_SQL)
    odd = F.col("case_id") % 2 == 1
    held = ("dataset_role", "gold_verified", "expected_format")
    out = out.withColumn("metadata", F.when(odd, F.create_map(*[x for c in held for x in (F.lit(c), F.col(c))])))
    return out.withColumns({c: F.when(~odd, F.col(c)) for c in held})


@query(f"WITH {_LIFE} SELECT case_id, case_status, gold_verified, human_review_required, gate_eligible FROM life")
def case_lifecycle(spark, d):
    """P3-P6, M8, M9."""
    return cases.with_lifecycle(raw(spark, d)).select("case_id", "case_status", "gold_verified", "human_review_required", "gate_eligible")


@query(f"""WITH r AS ({RAW_SQL}), b AS (SELECT *, coalesce(nullif(trim(expected_behavior), ''), CASE WHEN tool_calls > 0 THEN 'tool_call_then_grounded_answer' WHEN starts_with(lower(expected_format), 'json') THEN 'structured_output_required' END, '') AS eb FROM r)
SELECT case_id, eb AS expected_behavior, CASE WHEN tool_calls > 0 THEN 'tool_agent' WHEN eb = 'refuse_unsafe_request' THEN 'safety_refusal' WHEN eb = 'structured_output_required' THEN 'format_constrained_grounded_qa' WHEN eb = 'ask_clarifying_question' THEN 'clarification' ELSE coalesce(nullif(trim(question_type), ''), 'grounded_qa') END AS task_type FROM b""")
def case_behaviour(spark, d):
    """P8, P9."""
    return cases.with_behaviour(raw(spark, d)).select("case_id", "expected_behavior", "task_type")


@query(f"WITH {_LIFE} SELECT pool_id, count(*) AS cases, count(*) FILTER (WHERE gate_eligible) AS gate_eligible_cases, CASE WHEN bool_or(gate_eligible) THEN 'release_gate' WHEN bool_and(coalesce(lower(dataset_role), '') IN ('benchmark', '')) AND bool_or(coalesce(lower(dataset_role) = 'benchmark', false)) THEN 'benchmark' WHEN bool_or(case_status IN ('draft', 'shadow')) THEN 'exploratory_regression' ELSE 'not_applicable' END AS run_type FROM life GROUP BY 1")
def pool_run_type(spark, d):
    """P39."""
    return cases.run_type(cases.with_lifecycle(raw(spark, d)))


@query(f"WITH {_LIFE}, h AS (SELECT pool_id, bool_or(case_status = 'active') AS has FROM life GROUP BY 1) SELECT case_id, life.pool_id, case_status FROM life LEFT JOIN h ON life.pool_id = h.pool_id WHERE case_status = 'active' OR (case_status = 'shadow' AND NOT h.has)")
def cases_of_status(spark, d):
    """F3."""
    return cases.with_status(cases.with_lifecycle(raw(spark, d))).select("case_id", "pool_id", "case_status")


@query(f"WITH r AS ({RAW_SQL}) SELECT case_id FROM r WHERE dataset_role = 'Benchmark' AND NOT coalesce(question_type IN ('en', 'lang1'), false)")
def cases_of_pool(spark, d):
    """F1, F2."""
    return cases.in_pool(raw(spark, d), {"dataset_role": ["Benchmark"]}, {"question_type": ["en", "lang1"]}).select("case_id")


@query("SELECT case_id, CASE WHEN len(p) >= 2 THEN p[-2] || ' > ' || p[-1] ELSE trim(path) END AS topic FROM (SELECT *, list_filter(list_transform(string_split(path, '>'), lambda x: trim(x)), lambda x: x <> '') AS p FROM (SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ' > ' || lang || ' >> n' || doc_id % 5 || CASE WHEN doc_id % 2 = 0 THEN '> ' ELSE '' END END AS path FROM documents))")
def topic_paths(spark, d):
    """P11."""
    path = "CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ' > ' || lang || ' >> n' || doc_id % 5 || CASE WHEN doc_id % 2 = 0 THEN '> ' ELSE '' END END"
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("case_id"), cases.compact_topic(F.expr(path)).alias("topic"))


#: The first judge stands for the deterministic score, the consensus for the judges'.
_BOTH = f"{_CONSENSUS}, b AS (SELECT a.config_id, a.case_id, a.acc AS sacc, a.com AS scom, a.overall AS so, a.critical_fail AS sc, a.pass AS sp, s.acc AS jacc, s.com AS jcom, s.overall AS jo, s.critical_fail AS jc FROM p a JOIN s ON a.config_id = s.config_id AND a.case_id = s.case_id WHERE a.judge_id = 'j0' AND a.case_id % 4 <> 0 UNION ALL SELECT config_id, case_id, acc, com, overall, critical_fail, pass, NULL, NULL, NULL, NULL FROM p WHERE judge_id = 'j0' AND case_id % 4 = 0)"


def _both(spark, d):
    judged = _s(spark, d).where("case_id % 4 <> 0").withColumn("error_type", F.lit("normal"))
    return apply.attached(_v(spark, d).where("judge_id = 'j0'"), judged)


def _applied(name: str, mode: str, overall: str, metric: str, critical: str) -> None:
    def run(spark, d):
        return rounded(apply.applied(_both(spark, d), mode, 0.3).select("config_id", "case_id", "com", "overall", "critical_fail", "pass"), "com", "overall")

    run.__name__ = name
    query(f"WITH {_BOTH}, f AS (SELECT config_id, case_id, CASE WHEN jo IS NULL THEN scom ELSE {metric} END AS com, CASE WHEN jo IS NULL THEN so ELSE {overall} END AS o, CASE WHEN jo IS NULL THEN sc ELSE {critical} END AS c, jo, sp FROM b) SELECT config_id, case_id, round(com, 6) AS com, round(o, 6) AS overall, c AS critical_fail, CASE WHEN jo IS NULL THEN sp ELSE o >= 0.6 AND NOT c END AS pass FROM f")(run)


_applied("scores_audit", "audit", "so", "scom", "sc")
_applied("scores_override", "override", "jo", "jcom", "jc")
_applied("scores_blend", "blend", "so * (1 - 0.3::DOUBLE) + jo * 0.3::DOUBLE", "coalesce(scom, 0) * (1 - 0.3::DOUBLE) + coalesce(jcom, 0) * 0.3::DOUBLE", "sc OR jc")


@query(f"WITH {_BOTH}, f AS (SELECT config_id, CASE WHEN jo IS NULL THEN so ELSE so * 0.25::DOUBLE + jo * 0.75::DOUBLE END AS o, CASE WHEN jo IS NULL THEN sc ELSE sc OR jc END AS c FROM b) SELECT config_id, count(*) AS n, round(avg(o), 9) AS average, count(*) FILTER (WHERE o >= 0.5 AND NOT c) AS passed FROM f GROUP BY 1")
def reblended_run(spark, d):
    """P29, P30."""
    out = apply.reblended(apply.applied(_both(spark, d), "audit"), "blend", 0.75, 0.5)
    # halves of the sixth digit occur among these means, so the ninth is rounded
    return out.groupBy("config_id").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 9).alias("average"), F.count_if("pass").alias("passed"))


#: Answers: the document's text, every 23rd blank or failed, and none where (case + model) % 10 = 0.
OUTPUTS_SQL = """
SELECT 'm' || r_regionkey AS config_id, doc_id AS case_id, CASE WHEN (doc_id + r_regionkey) % 23 = 0 THEN 'provider_error' ELSE 'ok' END AS status,
  CASE WHEN (doc_id + 2 * r_regionkey) % 29 = 0 THEN ' ' ELSE text END AS model_answer, doc_id * 5 + r_regionkey AS seq
FROM documents CROSS JOIN region WHERE r_regionkey = 0 OR (doc_id + r_regionkey) % 10 <> 0
"""
_CONFIGS_SQL = "SELECT 'm' || r_regionkey AS config_id, lower(r_name) AS display_name FROM region"


def outputs(spark, d):
    return fx.frame(spark, d, OUTPUTS_SQL)


def configs(spark, d):
    return fx.frame(spark, d, _CONFIGS_SQL)


@query(f"WITH {_CONSENSUS}, o AS ({OUTPUTS_SQL}), k AS ({fx.CASES_SQL}), names AS ({_CONFIGS_SQL}) SELECT k.case_id, names.config_id, names.display_name, k.qa_topic, o.status, round(s.overall, 6) AS overall, s.pass FROM k CROSS JOIN names LEFT JOIN o ON o.config_id = names.config_id AND o.case_id = k.case_id LEFT JOIN s ON s.config_id = names.config_id AND s.case_id = k.case_id")
def question_cases_dense(spark, d):
    """J2, P24."""
    out = facts.dense(fx.cases(spark, d).select("case_id", "qa_topic"), configs(spark, d), outputs(spark, d).select("config_id", "case_id", "status"), _s(spark, d).select("config_id", "case_id", "overall", "pass"))
    return rounded(out, "overall")


@query(f"WITH {_CONSENSUS}, o AS ({OUTPUTS_SQL}), k AS ({fx.CASES_SQL}), names AS ({_CONFIGS_SQL}) SELECT o.config_id, o.case_id, o.status, k.qa_topic, names.display_name, round(s.overall, 6) AS overall, s.pass FROM o LEFT JOIN k ON o.case_id = k.case_id LEFT JOIN names ON names.config_id = o.config_id LEFT JOIN s ON s.config_id = o.config_id AND s.case_id = o.case_id")
def question_cases_sparse(spark, d):
    """J3."""
    out = facts.sparse(outputs(spark, d).select("config_id", "case_id", "status"), fx.cases(spark, d).select("case_id", "qa_topic"), configs(spark, d), _s(spark, d).select("config_id", "case_id", "overall", "pass"))
    return rounded(out, "overall")


@query(f"WITH {_NORMAL}, o AS ({OUTPUTS_SQL}) SELECT o.config_id, o.case_id, p.seq, p.judge_id, round(p.overall, 6) AS overall, p.pass, p.error_type FROM o JOIN p ON o.config_id = p.config_id AND o.case_id = p.case_id")
def verdicts_by_answer(spark, d):
    """J4, P22."""
    out = facts.with_verdicts(outputs(spark, d).select("config_id", "case_id"), _v(spark, d))
    return rounded(facts.flattened(out), "overall")


@query(f"WITH o AS ({OUTPUTS_SQL}), k AS (SELECT *, substr(sha256(concat_ws(chr(1), config_id, coalesce(model_answer, ''))), 1, 24) AS cache_key FROM o), c AS (SELECT cache_key, arg_max(model_answer, seq) AS a FROM k WHERE status = 'ok' AND trim(model_answer) <> '' AND case_id % 3 = 0 GROUP BY 1) SELECT config_id, case_id, cache_key, length(a) AS n FROM k JOIN c USING (cache_key)")
def answers_from_cache(spark, d):
    """A third of the answers is in the cache."""
    keyed = outputs(spark, d).withColumn("cache_key", facts.cache_key(F.col("config_id"), F.col("model_answer")))
    return facts.reusable(keyed.select("config_id", "case_id", "cache_key"), keyed.where("case_id % 3 = 0")).select("config_id", "case_id", "cache_key", F.length("model_answer").alias("n"))


@query(f"WITH o AS ({OUTPUTS_SQL}), k AS (SELECT *, config_id || ':' || case_id AS f, substr(sha256(concat_ws(chr(1), config_id, coalesce(model_answer, ''))), 1, 24) AS cache_key FROM o), d AS (SELECT * FROM k WHERE case_id % 3 = 0) SELECT config_id, case_id FROM k WHERE f NOT IN (SELECT f FROM d) AND cache_key NOT IN (SELECT cache_key FROM d)")
def answers_pending(spark, d):
    """J9, J10, R4."""
    keyed = outputs(spark, d).select("config_id", "case_id", F.concat_ws(":", "config_id", "case_id").alias("output_fingerprint"), facts.cache_key(F.col("config_id"), F.col("model_answer")).alias("cache_key"))
    return facts.pending(keyed, keyed.where("case_id % 3 = 0")).select("config_id", "case_id")


@query("SELECT name, CASE WHEN s = '' THEN 'unknown' ELSE substr(s, 1, 80) END AS slug FROM (SELECT p_name AS name, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM part)")
def cache_slugs(spark, d):
    """P46."""
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), facts.cache_slug(F.col("p_name")).alias("slug"))


@query(f"WITH o AS ({OUTPUTS_SQL}), f AS (SELECT config_id, count(DISTINCT case_id) AS have FROM o WHERE seq % 5 < 2 OR (status = 'ok' AND trim(model_answer) <> '') GROUP BY 1 HAVING have = (SELECT count(DISTINCT doc_id) FROM documents)) SELECT config_id, count(*) AS n FROM o WHERE config_id IN (SELECT config_id FROM f) GROUP BY 1")
def complete_models(spark, d):
    """F8."""
    out = outputs(spark, d).withColumns({"status": F.when(F.col("seq") % 5 < 2, "ok").otherwise(F.col("status")), "model_answer": F.when(F.col("seq") % 5 < 2, "a").otherwise(F.col("model_answer"))})
    return facts.complete_only(out, fx.cases(spark, d)).groupBy("config_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'over' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -s_suppkey, 'over' FROM supplier")
def registry_overlay(spark, d):
    """J16."""
    base = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = spark.read.parquet(f"{d}/supplier.parquet").select((-F.col("s_suppkey")).alias("id"), F.lit("over").alias("segment"))
    return facts.overlaid(base, base.where("id % 3 = 0").select("id", F.lit("over").alias("segment")).unionByName(new), "id")


@query(f"WITH o AS ({OUTPUTS_SQL}), v AS (SELECT config_id, case_id FROM ({fx.ARBITER_SQL})) (SELECT config_id, case_id, 'left' AS side FROM (SELECT config_id, case_id FROM o EXCEPT SELECT * FROM v)) UNION ALL (SELECT config_id, case_id, 'right' FROM (SELECT * FROM v EXCEPT SELECT config_id, case_id FROM o))")
def unmatched_keys(spark, d):
    """J13, J15, U3, U4."""
    return facts.unmatched(outputs(spark, d), judges.normalised(fx.arbiter(spark, d)), ["config_id", "case_id"])


@query(f"SELECT doc_id, substr(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1, 500) AS excerpt FROM documents")
def answer_excerpts(spark, d):
    """P25, over every text."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", facts.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT doc_id, length(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS size, substr(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1, 500) AS excerpt FROM documents")
def answer_excerpts_all(spark, d):
    """P25, with the length of the text that the excerpt is of."""
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length(squeezed(t)).alias("size"), facts.excerpt(t).alias("excerpt"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, CASE WHEN length(source) > 3 THEN substr(source, 1, 3) || '...' ELSE source END AS source FROM documents")
def compact_rows(spark, d):
    """P26."""
    return facts.compact(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"), {"text": 200, "source": 3})
