"""Queries of merged judge runs and of tool-agent traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import judges, merge, traces
from gradeflow.plans import fixtures as fx
from gradeflow.plans.queries import query, rounded

#: Every judge's run, and a second one over a sixth of the cases; some calls failed or were refused.
_RUNS = f"""SELECT config_id, case_id, judge_id, seq, r * 3 + seq AS run, CASE WHEN r = 1 THEN 2 - accuracy ELSE accuracy END AS accuracy, completeness, numerical_accuracy, hallucination, critical_fail, error_type,
  CASE WHEN f IN (0, 2, 4) THEN 'error' WHEN f = 1 THEN 'refused_by_provider_policy' WHEN f = 5 THEN 'skipped' ELSE 'ok' END AS status,
  CASE f WHEN 0 THEN 'HTTP Error 429: try again in 2.5s' WHEN 2 THEN 'request timed out' WHEN 3 THEN 'judged a sanitized safety-evaluation text' WHEN 4 THEN 'HTTP Error 429: exceeded your current quota, retry_after=30' WHEN 6 THEN 'Try again in 2m' ELSE 'fine' END AS reason
FROM (SELECT *, (case_id + 5 * seq + 3 * r + CAST(substr(config_id, 2) AS INT) * 7) % 29 AS f FROM ({fx.VERDICTS_SQL}) AS v CROSS JOIN (VALUES (0), (1)) AS again(r) WHERE r = 0 OR case_id % 6 = 0) AS w"""
_BLOCKED = "(lower(status) = 'refused_by_provider_policy' OR contains(lower(reason), 'cyber_policy') OR contains(lower(reason), 'sanitized safety-evaluation'))"
_GOOD = f"""rn AS (SELECT *, {_BLOCKED} AS blocked FROM ({_RUNS})),
gd AS (SELECT * FROM rn WHERE status = 'ok' AND NOT blocked QUALIFY row_number() OVER (PARTITION BY config_id, case_id, judge_id ORDER BY run DESC, seq DESC) = 1),
nv AS (SELECT *, accuracy / 2.0::DOUBLE AS acc, CASE WHEN completeness >= 0 THEN completeness / 2.0::DOUBLE END AS com, CASE WHEN numerical_accuracy >= 0 THEN numerical_accuracy::DOUBLE END AS nac, (1 - hallucination)::DOUBLE AS hal_pass FROM gd),
ov AS (SELECT *, (acc + coalesce(com, 0) + coalesce(nac, 0) + hal_pass) / (2 + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT) AS overall FROM nv), ps AS (SELECT *, overall >= 0.6 AND NOT critical_fail AS pass FROM ov)"""
#: From rows with a verdict of the good judges (ag) and a settled one (st): the merged rows.
_SETTLED = """er AS (SELECT config_id, case_id, arg_max(struct_pack(s := status, r := reason), struct_pack(b := blocked, r := run, q := seq)) AS last FROM rn WHERE blocked OR status = 'error' GROUP BY 1, 2),
ab AS (SELECT config_id, case_id, bool_or(blocked) AS manual, array_to_string(list_sort(list(DISTINCT run::VARCHAR)), ',') AS runs FROM rn GROUP BY 1, 2),
mg AS (SELECT config_id, case_id, CASE WHEN manual THEN 'refused_by_provider_policy' WHEN overall IS NOT NULL THEN 'ok' ELSE last.s END AS status, coalesce(ag.ok_judges, 0) AS ok_judges, overall, overall >= 0.6 AND NOT st.critical_fail AS pass, st.critical_fail, st.error_type,
  coalesce(st.conflict, false) OR manual AS conflict, CASE WHEN manual THEN 'manual_review_required' WHEN overall IS NOT NULL THEN st.settled END AS resolution, coalesce(st.settled IN ('review', 'unresolved'), false) OR manual AS unresolved, CASE WHEN overall IS NULL AND NOT manual THEN last.r END AS reason, runs
  FROM ab LEFT JOIN ag USING (config_id, case_id) LEFT JOIN st USING (config_id, case_id) LEFT JOIN er USING (config_id, case_id) WHERE overall IS NOT NULL OR last IS NOT NULL)"""
_MERGED = f"""{_GOOD},
ag AS (SELECT config_id, case_id, count(*) AS ok_judges, avg(acc) AS acc, avg(com) AS com, avg(nac) AS nac, avg(hal_pass) AS hal_pass, bool_or(critical_fail) AS critical_fail, coalesce(arg_min(error_type, struct_pack(o := overall, s := seq)) FILTER (WHERE error_type <> 'normal'), 'normal') AS error_type,
  count(*) > 1 AND (count(DISTINCT pass) > 1 OR max(overall) - min(overall) >= 0.3 OR count(DISTINCT error_type) FILTER (WHERE error_type <> 'normal') > 1) AS conflict FROM ps GROUP BY 1, 2),
st AS (SELECT *, (acc + coalesce(com, 0) + coalesce(nac, 0) + hal_pass) / (2 + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT) AS overall, CASE WHEN conflict THEN 'review' ELSE 'none' END AS settled FROM ag WHERE ok_judges >= 2),
{_SETTLED}"""

#: The third judge settles conflicts of the other two; where it spoke alone, it is the base.
_ARBITRATED = f"""{_GOOD},
bs AS (SELECT *, count(*) FILTER (WHERE judge_id <> 'j2') OVER (PARTITION BY config_id, case_id) AS others, count(*) OVER (PARTITION BY config_id, case_id) AS ok_judges FROM ps),
bm AS (SELECT config_id, case_id, ok_judges, avg(acc) AS acc, avg(com) AS com, avg(nac) AS nac, avg(hal_pass) AS hal_pass, bool_or(critical_fail) AS critical_fail, coalesce(arg_min(error_type, struct_pack(o := overall, s := seq)) FILTER (WHERE error_type <> 'normal'), 'normal') AS error_type,
  count(*) > 1 AND (count(DISTINCT pass) > 1 OR max(overall) - min(overall) >= 0.3 OR count(DISTINCT error_type) FILTER (WHERE error_type <> 'normal') > 1) AS conflict FROM bs WHERE judge_id <> 'j2' OR others = 0 GROUP BY 1, 2, 3),
ag AS (SELECT *, (acc + coalesce(com, 0) + coalesce(nac, 0) + hal_pass) / (2 + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT) AS own FROM bm),
ar AS (SELECT config_id, case_id, overall AS o, critical_fail AS c, error_type AS e FROM bs WHERE judge_id = 'j2' AND others > 0),
st AS (SELECT config_id, case_id, CASE WHEN conflict AND o IS NOT NULL THEN o ELSE own END AS overall, CASE WHEN conflict AND o IS NOT NULL THEN c ELSE critical_fail END AS critical_fail, CASE WHEN conflict AND o IS NOT NULL THEN e ELSE error_type END AS error_type,
  conflict, CASE WHEN conflict AND o IS NOT NULL THEN 'arbiter_override' WHEN conflict THEN 'unresolved' ELSE 'none' END AS settled FROM ag LEFT JOIN ar USING (config_id, case_id)),
{_SETTLED}"""
_ROWS = "SELECT config_id, case_id, status, ok_judges, round(overall, 6) AS overall, pass, critical_fail, error_type, conflict, resolution, unresolved, unresolved AS human_review_required, reason, runs FROM mg"


def runs(spark, d):
    return judges.normalised(fx.frame(spark, d, _RUNS))


def _merged(spark, d):
    return merge.merged(runs(spark, d), policy="review", method="mean", min_ok=2)


@query(f"WITH {_MERGED} {_ROWS}")
def judge_runs_merged(spark, d):
    """A10, J12, W2, W7, F10."""
    return rounded(_merged(spark, d), "overall")


@query(f"WITH {_MERGED} SELECT 'status' AS figure, status AS value, count(*) AS n FROM mg GROUP BY 2 UNION ALL SELECT 'ok_judges', ok_judges::VARCHAR, count(*) FROM mg GROUP BY 2 UNION ALL SELECT 'rows', 'conflict', count(*) FILTER (WHERE conflict) FROM mg UNION ALL SELECT 'rows', x, count(*) FILTER (WHERE unresolved) FROM mg, (VALUES ('unresolved'), ('human_review_required')) AS n(x) GROUP BY 2")
def merge_summary(spark, d):
    """A24."""
    return merge.merge_summary(_merged(spark, d))


@query(f"WITH {_ARBITRATED} {_ROWS}")
def judge_runs_arbitrated(spark, d):
    """The third judge settles conflicts of the other two."""
    return rounded(merge.merged(runs(spark, d), arbiter_id="j2", policy="arbiter_override", method="mean"), "overall")


@query(f"SELECT status, reason, count(*) AS n, bool_or({_BLOCKED} AND NOT contains(reason, 'sanitized')) AS refused, bool_or(contains(reason, 'sanitized')) AS sanitized, bool_or(status = 'error' AND (contains(lower(reason), '429') OR contains(reason, 'timed out'))) AS transient, bool_or(status = 'error' AND contains(lower(reason), '429') AND NOT contains(reason, 'quota')) AS rate_limited, max(CASE WHEN contains(reason, 'retry_after') THEN 30.0::DOUBLE WHEN contains(reason, '2.5s') THEN 2.5 WHEN contains(reason, '2m') THEN 120 ELSE 0 END) AS retry_after FROM ({_RUNS}) GROUP BY 1, 2")
def judge_error_classes(spark, d):
    """P48."""
    out = fx.frame(spark, d, _RUNS).withColumns(merge.error_classes(F.col("status"), F.col("reason")))
    flags = [F.bool_or(c).alias(c) for c in ("refused", "sanitized", "transient", "rate_limited")]
    return out.groupBy("status", "reason").agg(F.count("*").alias("n"), *flags, F.max("retry_after").alias("retry_after"))


@query(f"WITH v AS ({fx.VERDICTS_SQL}), w AS (SELECT *, CASE judge_id WHEN 'j0' THEN 0.5 WHEN 'j1' THEN 0.25 ELSE 0.25 END AS x FROM v WHERE case_id % 3 > 0 OR judge_id <> 'j1') SELECT config_id, case_id, judge_id, round(x / sum(x) OVER (PARTITION BY config_id, case_id), 9) AS weight FROM w")
def verdict_weights(spark, d):
    """By judge, else provider, else model; two thirds of the cases have all three."""
    v = fx.verdicts(spark, d).where("case_id % 3 > 0 or judge_id <> 'j1'")
    known = v.withColumns({"provider": F.when(F.col("judge_id") == "j1", "p1").otherwise("p"), "model": F.when(F.col("judge_id") == "j2", "big").otherwise("m")})
    out = merge.judge_weights(known, {"j0": 2.0, "p1": 1.0, "big": 1.0})
    return out.select("config_id", "case_id", "judge_id", F.round("weight", 9).alias("weight"))


def trace_tables(spark, d):
    """A scenario for each document, and two predictions for some; what is called, made and said follows from ids."""
    docs = fx.frame(spark, d, "SELECT doc_id AS i, '' || doc_id AS scenario_id, coalesce(source, '') AS source, coalesce(lang, 'xx') AS lang, coalesce(text, '') AS text, n_chars FROM documents")
    at = lambda k, n: F.col("i") % n == k
    call = lambda name, args, must=True: F.struct(F.lit(name).alias("tool_name"), args.alias("arguments"), F.lit(must).alias("must_call"))
    act = lambda name, args: F.struct(F.lit(name).alias("tool_name"), args.alias("arguments"))
    row = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    args = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v.cast("string"))])
    stages = F.when(at(0, 3), F.array(F.lit("tool_call"), F.lit("tool_result_refinement"))).when(at(1, 3), F.array(F.lit("tool_creation"))).otherwise(F.array(F.lit("tool_call"), F.lit("tool_creation"), F.lit("tool_result_refinement")))
    wanted = F.when(at(0, 5), F.expr("array()").cast("array<struct<tool_name: string, arguments: map<string, string>, must_call: boolean>>")).otherwise(F.array(call("search", args(query_contains_any=F.concat_ws("|", "source", "lang"), top_k=F.lit("10"))), call("open", args(doc=F.concat(F.lit("doc "), F.col("i")))), call("note", args(x=F.lit("y")), False)))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    tool = F.when(at(1, 4), F.struct(F.lit("sum_rows").alias("name"), words("a", "b").alias("inputs"), words("total").alias("outputs"), words("pure").alias("constraints"), words("no network").alias("safety"), words("3").alias("tests")))
    given = docs.select("scenario_id", F.when(at(0, 10), "no_tool_safety").otherwise("tool_call").alias("category"), F.concat(F.lit("P"), F.col("i") % 5).alias("priority"), F.lit("medium").alias("difficulty"), F.concat_ws(" ", F.lit("find"), "source").alias("query"), stages.alias("stage_targets"), F.array(row(name=F.lit("search"), allowed=F.lit(True)), row(name=F.lit("open"), allowed=~at(0, 7))).alias("tools"), wanted.alias("expected_actions"), F.when(~at(2, 6), F.array("text", "lang")).alias("observations"), F.array("lang", "source").alias("must_include"), F.array(F.lit("zz"), F.lit("token =")).alias("must_not_include"), tool.alias("expected_tool"))
    search, opened = act("search", args(query=F.concat_ws(" ", F.lit("in"), "source"), top_k=F.when(at(1, 2), "10").otherwise("ten, 10"))), act("open", args(doc=F.when(at(1, 8), "none").otherwise(F.col("scenario_id"))))
    acts = F.when(at(3, 9), F.array(opened, search)).when(at(4, 9), F.array(search)).when(at(5, 9), F.array(search, search, opened, act("shell", args(cmd=F.lit("ls"))))).otherwise(F.array(search, opened))
    made = F.when(at(2, 3), F.array(row(name=F.lit("other"), inputs=F.lit("a"), outputs=F.lit(""), constraints=F.lit(""), safety=F.lit(""), tests=F.lit("")), row(name=F.lit("my sum_rows"), inputs=F.lit("a and b"), outputs=F.lit("the total"), constraints=F.lit("pure"), safety=F.when(at(1, 8), "no network").otherwise("none"), tests=F.lit("1 + 2 = 3"))))
    said = F.when(at(6, 11), "").otherwise(F.concat_ws(" ", "lang", "source", "text"))
    predicted = docs.where("i % 13 > 0").select("scenario_id", F.lit(0).alias("seq"), acts.alias("actions"), made.alias("created_tools"), said.alias("final_answer"))
    return given, predicted.unionByName(predicted.where("scenario_id % 17 = 0").withColumns({"seq": F.lit(1), "final_answer": F.lit("again 12,345 won")}))


@query()
def tool_traces_scored(spark, d):
    """A scenario and its prediction for each document."""
    out = traces.scored_traces(*trace_tables(spark, d))
    return out.withColumns({c: F.array_join(c, "|") for c in ("stage_targets", "blocking_failures")})


@query()
def tool_trace_summary(spark, d):
    """A20."""
    return rounded(traces.trace_summary(traces.scored_traces(*trace_tables(spark, d))), "overall_score")


@query("SELECT '' || doc_id AS scenario_id, coalesce(nullif(source, ''), '') AS query, 'tool_call' AS category, CASE WHEN nullif(lang, '') IS NULL THEN 'P1' ELSE lang END AS priority, 'medium' AS difficulty, 'tool_call,tool_result_refinement' AS stages FROM documents")
def trace_scenarios(spark, d):
    """T20."""
    seeds = fx.frame(spark, d, "SELECT '' || doc_id AS case_id, source AS question, lang AS priority FROM documents")
    return traces.scenarios(seeds).select("scenario_id", "query", "category", "priority", "difficulty", F.array_join("stage_targets", ",").alias("stages"))
