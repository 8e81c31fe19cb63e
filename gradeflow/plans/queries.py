"""One query for each operator over the derived tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import compare, compose, judges, snapshot, tables, textsim, views
from gradeflow.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}

_NORMAL = f"""v AS (SELECT *, (acc + coalesce(com, 0) + coalesce(nac, 0) + hal_pass) / (2 + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT) AS overall FROM (
  SELECT *, accuracy / 2.0::DOUBLE AS acc, CASE WHEN completeness >= 0 THEN completeness / 2.0::DOUBLE END AS com, CASE WHEN numerical_accuracy >= 0 THEN numerical_accuracy::DOUBLE END AS nac, (1 - hallucination)::DOUBLE AS hal_pass FROM ({fx.VERDICTS_SQL}))),
p AS (SELECT *, overall >= 0.6 AND NOT critical_fail AS pass FROM v)"""
_MEAN = "(coalesce(acc, 0) + coalesce(com, 0) + coalesce(nac, 0) + coalesce(hal_pass, 0)) / ((acc IS NOT NULL)::INT + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT + (hal_pass IS NOT NULL)::INT)"
_CONSENSUS = f"""{_NORMAL},
g AS (SELECT config_id, case_id, avg(acc) AS acc, avg(com) AS com, avg(nac) AS nac, avg(hal_pass) AS hal_pass, round(max(overall) - min(overall), 6) AS overall_gap,
  greatest(max(acc) - min(acc), coalesce(max(com) - min(com), 0), coalesce(max(nac) - min(nac), 0), max(hal_pass) - min(hal_pass)) AS metric_max_gap,
  count(DISTINCT pass) > 1 AS pass_mismatch, bool_or(critical_fail) AS critical_fail, count(*) AS judges FROM p GROUP BY 1, 2),
c AS (SELECT *, {_MEAN} AS overall, CASE WHEN pass_mismatch OR overall_gap >= 0.3 THEN 'review_needed' WHEN overall_gap >= 0.15 THEN 'borderline' ELSE 'stable' END AS agreement_status FROM g),
s AS (SELECT *, overall >= 0.6 AND NOT critical_fail AS pass FROM c)"""
_CASES = f"k AS (SELECT *, active AND gold_verified AS gate_eligible FROM ({fx.CASES_SQL}))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _v(spark: SparkSession, d: str) -> DataFrame:
    return judges.normalised(fx.verdicts(spark, d))


def _s(spark: SparkSession, d: str) -> DataFrame:
    return judges.consensus(_v(spark, d))


@query(f"WITH {_CONSENSUS}, b AS (SELECT config_id, count(*) AS cases, avg(overall) AS a, avg(pass::INT) AS pr, count(*) FILTER (WHERE agreement_status = 'review_needed') AS review_needed FROM s GROUP BY 1) SELECT config_id, cases, round(a, 6) AS average, round(pr, 6) AS pass_rate, review_needed, row_number() OVER (ORDER BY a DESC, config_id) AS rank FROM b")
def leaderboard_by_consensus(spark, d):
    """A11, A6, W1, P17."""
    return rounded(snapshot.leaderboard(_s(spark, d)), "average", "pass_rate")


@query(f"WITH {_NORMAL} SELECT config_id, case_id, judge_id, acc, com, nac, hal_pass, round(overall, 6) AS overall, pass FROM p")
def verdicts_normalised(spark, d):
    """P17, M1-M3."""
    return rounded(_v(spark, d).select("config_id", "case_id", "judge_id", "acc", "com", "nac", "hal_pass", "overall", "pass"), "overall")


@query(f"WITH {_CONSENSUS} SELECT config_id, case_id, round(overall, 6) AS overall, overall_gap, metric_max_gap, pass_mismatch, critical_fail, judges, agreement_status, pass FROM s")
def consensus_of_judges(spark, d):
    """A6, A8, P32."""
    return rounded(_s(spark, d).select("config_id", "case_id", "overall", "overall_gap", "metric_max_gap", "pass_mismatch", "critical_fail", "judges", "agreement_status", "pass"), "overall")


def _aggregate(name: str, method: str, expr, weights=None) -> None:
    cols = ", ".join(f"{expr(m)} AS {m}" for m in ("acc", "com", "nac", "hal_pass"))
    sql = f"WITH {_NORMAL}, g AS (SELECT config_id, case_id, {cols}, bool_or(critical_fail) AS critical_fail FROM p GROUP BY 1, 2) SELECT config_id, case_id, round(acc, 6) AS acc, round(com, 6) AS com, round(nac, 6) AS nac, round(hal_pass, 6) AS hal_pass, critical_fail, round({_MEAN}, 6) AS overall FROM g"

    def run(spark, d):
        out = judges.aggregated(_v(spark, d), method, weights).select("config_id", "case_id", "acc", "com", "nac", "hal_pass", "critical_fail", "overall")
        return rounded(out, "acc", "com", "nac", "hal_pass", "overall")

    run.__name__ = name
    query(sql)(run)


_TRIM = lambda m: f"CASE WHEN count({m}) >= 3 THEN (sum({m}) - min({m}) - max({m})) / (count({m}) - 2) ELSE avg({m}) END"
_WEIGHT = "(CASE judge_id WHEN 'j0' THEN 0.5 WHEN 'j1' THEN 0.3 ELSE 0.2 END)"
_aggregate("judges_mean", "mean", lambda m: f"avg({m})")
_aggregate("judges_trimmed_mean", "trimmed_mean", _TRIM)
_aggregate("judges_auto", "auto", _TRIM)
_aggregate("judges_weighted_mean", "weighted_mean", lambda m: f"sum({m} * {_WEIGHT}::DOUBLE) / sum(CASE WHEN {m} IS NOT NULL THEN {_WEIGHT}::DOUBLE END)", {"j0": 0.5, "j1": 0.3, "j2": 0.2})
_aggregate("judges_best", "max", lambda m: f"arg_min(struct_pack(x := {m}), struct_pack(o := -overall, s := seq)).x")
_aggregate("judges_worst", "min", lambda m: f"arg_min(struct_pack(x := {m}), struct_pack(o := overall, s := seq)).x")


@query(f"""WITH {_NORMAL}, g AS (SELECT config_id, case_id, count(DISTINCT pass) > 1 AS pc, max(overall) - min(overall) AS gap, list_sort(list(DISTINCT error_type) FILTER (WHERE error_type <> 'normal')) AS e FROM p GROUP BY 1, 2)
SELECT config_id, case_id, pc OR gap >= 0.3 OR coalesce(len(e), 0) > 1 AS conflict, coalesce(array_to_string(list_filter([CASE WHEN pc THEN 'judge pass/fail disagreement' END, CASE WHEN gap >= 0.3 THEN 'judge score gap ' || printf('%.3f', gap) END, CASE WHEN len(e) > 1 THEN 'judge error-type disagreement: ' || array_to_string(e, ', ') END], lambda x: x IS NOT NULL), '; '), '') AS reason FROM g""")
def judge_conflicts(spark, d):
    """A7."""
    return judges.conflicts(_v(spark, d)).select("config_id", "case_id", "conflict", "reason")


_ARBITER = _NORMAL.replace(fx.VERDICTS_SQL, fx.ARBITER_SQL).replace("v AS (", "av AS (").replace("p AS (", "ap AS (").replace("FROM v)", "FROM av)")


@query(f"""WITH {_NORMAL}, {_ARBITER}, cf AS (SELECT config_id, case_id, count(DISTINCT pass) > 1 OR max(overall) - min(overall) >= 0.3 OR count(DISTINCT error_type) FILTER (WHERE error_type <> 'normal') > 1 AS conflict FROM p GROUP BY 1, 2),
b AS (SELECT *, false AS settled FROM p UNION ALL SELECT *, true FROM ap), vt AS (SELECT b.*, cf.conflict FROM b JOIN cf USING (config_id, case_id) WHERE NOT settled OR conflict),
g AS (SELECT config_id, case_id, conflict, bool_or(settled) AS settled, {", ".join(f"CASE WHEN count({m}) >= 3 AND count(*) >= 3 THEN (sum({m}) - min({m}) - max({m})) / (count({m}) - 2) ELSE avg({m}) END AS {m}" for m in ("acc", "com", "nac", "hal_pass"))}, bool_or(critical_fail) AS critical_fail FROM vt GROUP BY 1, 2, 3),
o AS (SELECT *, {_MEAN} AS overall FROM g)
SELECT config_id, case_id, round(overall, 6) AS overall, overall >= 0.6 AND NOT critical_fail AS pass, conflict, CASE WHEN settled THEN 'three_judge' WHEN conflict THEN 'unresolved' ELSE 'none' END AS resolution, conflict AND NOT settled AS unresolved FROM o""")
def conflicts_resolved_with_arbiter(spark, d):
    """A9, J6."""
    arb = judges.normalised(fx.arbiter(spark, d))
    out = judges.resolved(_v(spark, d), arb, "three_judge").select("config_id", "case_id", "overall", "pass", "conflict", "resolution", "unresolved")
    return rounded(out, "overall")


@query(f"WITH {_CONSENSUS} SELECT config_id, count(*) AS total_questions, count(*) FILTER (WHERE agreement_status <> 'review_needed') AS scored_questions, count(*) FILTER (WHERE agreement_status = 'review_needed') AS review_pending_count, round(avg(pass::INT), 6) AS pass_rate, round(avg(overall), 6) AS overall_score, round(avg(pass::INT) FILTER (WHERE agreement_status <> 'review_needed'), 6) AS scored_pass_rate, round(avg(overall) FILTER (WHERE agreement_status <> 'review_needed'), 6) AS scored_average, round(avg(acc), 6) AS acc, round(avg(com), 6) AS com, round(avg(nac), 6) AS nac, round(avg(hal_pass), 6) AS hal_pass FROM s GROUP BY 1")
def model_summary(spark, d):
    """A1, A2."""
    out = tables.model_summary(_s(spark, d), F.col("agreement_status") == "review_needed")
    return rounded(out, "pass_rate", "overall_score", "scored_pass_rate", "scored_average", "acc", "com", "nac", "hal_pass")


@query(f"""WITH {_CONSENSUS} SELECT a.config_id, a.case_id, b.pass AS baseline_pass, a.pass, round(a.overall - b.overall, 6) AS score_delta,
CASE WHEN b.pass AND NOT a.pass THEN 'new_failure' WHEN NOT b.pass AND a.pass THEN 'fixed_failure' WHEN NOT b.pass THEN 'persistent_failure' WHEN a.overall - b.overall <= -0.05 THEN 'score_drop' WHEN a.overall - b.overall >= 0.05 THEN 'score_gain' ELSE 'stable' END AS regression_type
FROM s a JOIN s b ON a.case_id = b.case_id AND b.config_id = 'm0' WHERE a.config_id <> 'm0'""")
def regression_diff(spark, d):
    """J1, P34."""
    return rounded(tables.regressions(_s(spark, d), "m0", 0.05).select("config_id", "case_id", "baseline_pass", "pass", "score_delta", "regression_type"), "score_delta")


@query(f"""WITH {_CONSENSUS}, {_CASES}, h AS (SELECT s.*, k.gate_eligible, k.qa_topic = 'long' AS core, CASE WHEN NOT k.gate_eligible THEN 'not_applicable' WHEN s.agreement_status = 'review_needed' THEN 'review' WHEN s.critical_fail THEN 'review' WHEN s.pass THEN 'pass' WHEN k.severity IN ('high', 'critical') THEN 'block' ELSE 'review' END AS gate FROM s JOIN k USING (case_id)),
r AS (SELECT config_id, count(*) AS evaluated_cases, count(*) FILTER (WHERE gate_eligible) AS gate_eligible_cases, count(*) FILTER (WHERE gate = 'pass') AS pass_count, count(*) FILTER (WHERE gate = 'review') AS review_count, count(*) FILTER (WHERE gate = 'block') AS block_count, avg(pass::INT) FILTER (WHERE gate_eligible AND core) AS core FROM h GROUP BY 1)
SELECT config_id, evaluated_cases, gate_eligible_cases, pass_count, review_count, block_count, round(core, 6) AS core_pass_rate, CASE WHEN gate_eligible_cases = 0 THEN 'not_applicable' WHEN block_count > 0 OR coalesce(core < 0.5, false) THEN 'block' WHEN review_count > 0 THEN 'review' ELSE 'pass' END AS release_gate FROM r""")
def release_gates(spark, d):
    """A3, J11, P31."""
    scores = _s(spark, d).withColumn("error_type", F.lit("normal"))
    out = tables.release_gates(scores, fx.cases(spark, d), F.col("qa_topic") == "long", 0.5, F.col("agreement_status") == "review_needed")
    return rounded(out.drop("reason"), "core_pass_rate")


@query(f"""WITH {_CONSENSUS}, {_CASES}, j AS (SELECT s.config_id, s.case_id, s.overall, s.pass, qa_category, question_type, qa_topic FROM s JOIN k USING (case_id)),
x AS (SELECT config_id, qa_category a, question_type b, qa_topic c, grouping(qa_category) ga, grouping(question_type) gb, grouping(qa_topic) gc, count(DISTINCT case_id) AS case_count, count(*) AS row_count, avg(overall) AS o, avg(pass::INT) AS pr FROM j
GROUP BY GROUPING SETS ((config_id, qa_category), (config_id, question_type), (config_id, qa_topic), (config_id, qa_category, question_type), (config_id, qa_category, qa_topic), (config_id, question_type, qa_topic), (config_id, qa_category, question_type, qa_topic)))
SELECT config_id, concat_ws(' x ', CASE WHEN ga = 0 THEN 'qa_category' END, CASE WHEN gb = 0 THEN 'question_type' END, CASE WHEN gc = 0 THEN 'qa_topic' END) AS dimension, concat_ws(' | ', CASE WHEN ga = 0 THEN coalesce(a, 'unknown') END, CASE WHEN gb = 0 THEN coalesce(b, 'unknown') END, CASE WHEN gc = 0 THEN coalesce(c, 'unknown') END) AS value, case_count, row_count, round(o, 9) AS overall, round(pr, 9) AS pass_rate, CASE WHEN case_count >= 30 THEN 'reliable' ELSE 'insufficient_n' END AS reliability FROM x""")
def slice_scores(spark, d):
    """A4, A12."""
    # the ninth digit: the sixth meets exact halves
    return tables.slices(_s(spark, d), fx.cases(spark, d)).withColumns({c: F.round(c, 9) for c in ("overall", "pass_rate")})


_GATES = "z AS (SELECT *, CASE WHEN pass THEN 'pass' ELSE 'fail' END AS q, CASE agreement_status WHEN 'review_needed' THEN 'review' WHEN 'borderline' THEN 'monitor' ELSE 'pass' END AS a FROM s), y AS (SELECT *, CASE WHEN a = 'review' THEN 'review' ELSE q END AS f FROM z)"


@query(f"WITH {_CONSENSUS}, {_GATES} SELECT config_id, case_id, q AS quality_gate, a AS judge_agreement_gate, f AS final_gate FROM y")
def case_gates(spark, d):
    """P33."""
    return snapshot.case_gates(_s(spark, d)).select("config_id", "case_id", "quality_gate", "judge_agreement_gate", "final_gate")


@query(f"WITH {_CONSENSUS}, {_GATES} SELECT config_id, " + ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {n}_{v}" for c, n, vs in (("q", "quality_gate", ("pass", "fail")), ("a", "judge_agreement_gate", ("pass", "monitor", "review")), ("f", "final_gate", ("pass", "fail", "review"))) for v in vs) + " FROM y GROUP BY 1")
def gate_summary(spark, d):
    """A14."""
    return snapshot.gate_summary(snapshot.case_gates(_s(spark, d)))


@query(f"WITH {_NORMAL} SELECT judge_id, config_id, count(*) AS n, round(avg(overall), 6) AS average, round(min(overall), 6) AS lowest, round(max(overall), 6) AS highest, round(avg(pass::INT), 6) AS pass_rate FROM p GROUP BY GROUPING SETS ((judge_id), (judge_id, config_id))")
def judge_summary(spark, d):
    """A13."""
    return rounded(snapshot.judge_summary(_v(spark, d)).drop("acc", "com", "nac", "hal_pass"), "average", "lowest", "highest", "pass_rate")


@query(f"WITH {_NORMAL} SELECT judge_id, config_id, count(*) AS n, round(avg(overall), 6) AS average, round(min(overall), 6) AS lowest, round(max(overall), 6) AS highest, round(avg(pass::INT), 6) AS pass_rate, round(avg(acc), 9) AS acc, round(avg(com), 9) AS com, round(avg(nac), 9) AS nac, round(avg(hal_pass), 9) AS hal_pass FROM p GROUP BY GROUPING SETS ((judge_id), (judge_id, config_id))")
def judge_summary_all(spark, d):
    """A13 with the metric means."""
    out = rounded(snapshot.judge_summary(_v(spark, d)), "average", "lowest", "highest", "pass_rate")
    return out.withColumns({m: F.round(m, 9) for m in ("acc", "com", "nac", "hal_pass")})


@query(f"WITH {_CONSENSUS} SELECT count(*) AS n, round(avg(overall), 6) AS average, round(min(overall), 6) AS lowest, round(max(overall), 6) AS highest, count(*) FILTER (WHERE pass) AS passed FROM s")
def run_summary(spark, d):
    """A15."""
    return rounded(snapshot.run_summary(_s(spark, d)), "average", "lowest", "highest")


_PAIRS = _NORMAL + ", w AS (SELECT a.config_id, a.case_id, a.pass AS bp, b.pass AS op, b.overall - a.overall AS delta, abs(b.overall - a.overall) AS gap FROM p a JOIN p b ON a.config_id = b.config_id AND a.case_id = b.case_id AND a.judge_id = 'j0' AND b.judge_id = 'j1')"


def _pairs(spark, d):
    v = _v(spark, d)
    return compare.compared(v.where("judge_id = 'j0'"), v.where("judge_id = 'j1'"))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(quantile_cont(gap, 0.9), 6) AS p90_gap, round(quantile_cont(gap, 0.95), 6) AS p95_gap, count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta < 0) AS down, count(*) FILTER (WHERE bp <> op) AS pass_changed FROM w")
def comparison_summary(spark, d):
    """A16, A17, J5."""
    return rounded(compare.summary(_pairs(spark, d)), "mean_delta", "mean_gap", "median_gap", "p90_gap", "p95_gap")


@query(f"WITH {_PAIRS}, e(band, least) AS (VALUES (0, 0.0::DOUBLE), (1, 0.05), (2, 0.1), (3, 0.2), (4, 0.3)) SELECT band, least, (SELECT count(*) FROM w WHERE gap >= e.least AND gap < coalesce((SELECT min(x.least) FROM e x WHERE x.least > e.least), 99)) AS n FROM e")
def comparison_bands(spark, d):
    """A18, D2."""
    return compare.bands(_pairs(spark, d), (0.0, 0.05, 0.1, 0.2, 0.3))


@query(f"WITH {_PAIRS} SELECT config_id, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(gap), 6) AS mean_gap FROM w GROUP BY 1")
def comparison_by_model(spark, d):
    """A19."""
    return rounded(compare.by_model(_pairs(spark, d)), "mean_delta", "mean_gap")


@query(f"WITH {_PAIRS}, t AS (SELECT 'up' AS list, config_id, case_id, delta, row_number() OVER (ORDER BY delta DESC, config_id, case_id) AS rank FROM w UNION ALL SELECT 'down', config_id, case_id, delta, row_number() OVER (ORDER BY delta, config_id, case_id) FROM w) SELECT list, config_id, case_id, round(delta, 6) AS delta, rank FROM t WHERE rank <= 30")
def comparison_extremes(spark, d):
    """W4."""
    return rounded(compare.extremes(_pairs(spark, d)).where("list <> 'gap'").select("list", "config_id", "case_id", "delta", "rank"), "delta")


@query(f"WITH {_PAIRS}, t AS (SELECT 'up' AS list, config_id, case_id, delta, gap, row_number() OVER (ORDER BY delta DESC, config_id, case_id) AS rank FROM w UNION ALL SELECT 'down', config_id, case_id, delta, gap, row_number() OVER (ORDER BY delta, config_id, case_id) FROM w UNION ALL SELECT 'gap', config_id, case_id, delta, gap, row_number() OVER (ORDER BY gap DESC, config_id, case_id) FROM w) SELECT list, config_id, case_id, round(delta, 6) AS delta, round(gap, 6) AS gap, rank FROM t WHERE rank <= CASE WHEN list = 'gap' THEN 100 ELSE 30 END")
def comparison_extremes_all(spark, d):
    """W4, all three lists."""
    return rounded(compare.extremes(_pairs(spark, d)).select("list", "config_id", "case_id", "delta", "gap", "rank"), "delta", "gap")


@query(f"WITH {_CASES}, o AS (SELECT case_id, qa_category AS pool_id, row_number() OVER (PARTITION BY qa_category ORDER BY sha256('7:' || qa_category || ':' || case_id), case_id) AS n FROM k WHERE qa_category IN ('src0', 'src3', 'src5')) SELECT pool_id, case_id FROM o WHERE n <= 8")
def quota_sample(spark, d):
    """W5, F1."""
    pools = fx.cases(spark, d).withColumn("pool_id", F.col("qa_category"))
    return compose.sampled(pools, {"src0": 8, "src3": 8, "src5": 8}, "7", strict=False).select("pool_id", "case_id")


@query(f"WITH {_CONSENSUS} SELECT case_id, count(DISTINCT pass) AS outcomes, round(max(overall) - min(overall), 6) AS spread FROM s GROUP BY 1 HAVING count(DISTINCT pass) > 1 OR max(overall) - min(overall) >= 0.15")
def models_disagree(spark, d):
    """A23."""
    return rounded(views.disagreeing(_s(spark, d)), "spread")


@query(f"WITH {_CONSENSUS}, m AS (SELECT case_id, max((NOT pass)::INT) AS has_failure, max((agreement_status = 'review_needed')::INT) AS has_review, min(round(overall, 6)) AS worst FROM s GROUP BY 1) SELECT * FROM m ORDER BY has_failure DESC, has_review DESC, worst, case_id LIMIT 120")
def result_matrix(spark, d):
    """K1."""
    return views.result_matrix(rounded(_s(spark, d), "overall"), F.col("agreement_status") == "review_needed")


@query(f"WITH {_CASES}, f AS (SELECT 'qa_category' AS field, coalesce(qa_category, 'unknown') AS value FROM k UNION ALL SELECT 'question_type', coalesce(question_type, 'unknown') FROM k UNION ALL SELECT 'qa_topic', qa_topic FROM k), n AS (SELECT field, value, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM n) SELECT * FROM r WHERE rank <= 20")
def dataset_profile(spark, d):
    """A22."""
    return views.profile(fx.cases(spark, d), ["qa_category", "question_type", "qa_topic"])


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(chr(1), text, source)), 'tion the')")
def text_search(spark, d):
    """F6."""
    return views.searched(spark.read.parquet(f"{d}/documents.parquet"), "TION the", ["text", "source"]).select("doc_id")


#: White space as Unicode knows it, for SQL.
WS = "[\\t\\n\\x0B\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def grams_sql(pairs: str, keys: str) -> str:
    """CTEs of n-gram counts of the compact texts t of (keys, side, t) in the table ``pairs``, for n = 2, 3, 4."""
    return f"""ch AS (SELECT {keys}, side, length(t) AS size, t, unnest(string_split(t, '')) AS c, unnest(range(1, length(t) + 1)) AS i FROM {pairs} WHERE t <> ''),
ld AS (SELECT {keys}, side, size, t, i, c || lead(c, 1) OVER w AS g2, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS g3, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w AS g4 FROM ch WINDOW w AS (PARTITION BY {keys}, side ORDER BY i)),
gr AS (SELECT {keys}, side, n, CASE WHEN size < n THEN t WHEN n = 2 THEN g2 WHEN n = 3 THEN g3 ELSE g4 END AS gram FROM ld, (VALUES (2), (3), (4)) AS sizes(n) WHERE size >= n OR i = 1),
gc AS (SELECT {keys}, side, n, hash(gram) AS g, count(*) AS m FROM gr WHERE gram IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH p AS (SELECT a.doc_id AS key, lower(regexp_replace(coalesce(a.text, ''), '{WS}', '', 'g')) AS l, lower(regexp_replace(coalesce(b.text, ''), '{WS}', '', 'g')) AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
tx AS (SELECT key, 'l' AS side, l AS t FROM p UNION ALL SELECT key, 'r', r FROM p), {grams_sql("tx", "key")},
nm AS (SELECT key, n, sqrt(sum(m * m) FILTER (WHERE side = 'l')) AS ln, sqrt(sum(m * m) FILTER (WHERE side = 'r')) AS rn FROM gc GROUP BY ALL),
dt AS (SELECT a.key, a.n, sum(a.m * b.m)::DOUBLE AS dot FROM gc a JOIN gc b ON a.key = b.key AND a.n = b.n AND a.g = b.g AND a.side = 'l' AND b.side = 'r' GROUP BY ALL),
cs AS (SELECT key, max(dot / (ln * rn)) AS cosine FROM dt JOIN nm USING (key, n) GROUP BY 1)
SELECT key, round(coalesce(cosine, 0), 9) AS cosine FROM p LEFT JOIN cs USING (key)""")
def answer_gram_cosine(spark, d):
    """Each document against the next one."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    pairs = docs.alias("a").join(docs.alias("b"), F.expr("b.doc_id = a.doc_id + 1")).selectExpr("a.doc_id as key", "a.text as reference", "b.text as answer")
    # the work is in the texts, so rows are dealt to all tasks whatever the files' sizes
    pairs = pairs.repartition(spark.sparkContext.defaultParallelism)
    return pairs.select("key", F.round(textsim.gram_cosine(F.col("reference"), F.col("answer")), 9).alias("cosine"))
