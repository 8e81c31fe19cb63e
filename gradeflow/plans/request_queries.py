"""Queries of requests and responses, the full comparison report, and dataset profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow import api
from gradeflow.functions.columns import json_as_text, json_fingerprint
from gradeflow.operators import compare, compose, facts, merge, requests, review, tables, textsim, views
from gradeflow.plans import fixtures as fx
from gradeflow.plans.merge_queries import _RUNS, runs
from gradeflow.plans.queries import _CASES, _CONSENSUS, _NORMAL, _PAIRS, SQL, WS, _pairs, _s, _v, query, rounded
from gradeflow.plans.view_queries import _ROWS, rows

_TURNS = "SELECT conv_id AS case_id, turn, role, text FROM conversations"


@query(f"""WITH c AS (SELECT conv_id, list(struct_pack(t := turn, r := coalesce(nullif(role, ''), 'user'), x := coalesce(text, '')) ORDER BY turn, role, text) AS turns FROM conversations GROUP BY 1),
e AS (SELECT conv_id, turns, trim(regexp_replace(coalesce(b.text, ''), '{WS}', ' ', 'g')) AS e FROM c LEFT JOIN benchmark b ON b.item_id = conv_id % (SELECT count(*) FROM benchmark)),
m AS (SELECT conv_id, [x FOR x IN turns IF x.x <> ''] AS kept, e FROM e)
SELECT conv_id AS case_id, 'system:Be brief' || CASE WHEN e <> '' THEN '|system:{requests.EVIDENCE_HEAD[0]}' || chr(10) || '{requests.EVIDENCE_HEAD[1]}' || chr(10) || '[1] {requests.TITLE}T' || chr(10) || '{requests.CONTENT}' || substr(e, 1, 1200) ELSE '' END || '|' || array_to_string([x.r || ':' || CASE WHEN x.r = 'user' THEN 'Q ' || conv_id || ': ' || x.x ELSE x.x END FOR x IN kept], '|') AS messages FROM m""")
def chat_messages(spark, d):
    """Conversations with a passage of the benchmark as evidence."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    cases = fx.frame(spark, d, _TURNS).groupBy("case_id").agg(turns.alias("conversation_turns"))
    cases.createOrReplaceTempView("chats")
    cases = fx.frame(spark, d, "SELECT c.*, b.text AS passage FROM chats c LEFT JOIN benchmark b ON b.item_id = c.case_id % (SELECT count(*) FROM benchmark)")
    evidence = F.array(F.struct(F.when(F.col("passage").isNotNull(), "T").alias("title"), F.lit("").alias("url"), F.col("passage").alias("excerpt")))
    cases = cases.withColumns({"gold_evidence": evidence, "question": F.lit(""), "suite": F.lit("core"), "gold_answer": F.lit("")})
    out = requests.messages(cases, system="Be brief", template="Q {case_id}: {question}")
    return out.select("case_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("messages"))


_RESPONSES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"choices": [{"message": {"content": "' || event_type || '"}}]}' WHEN 1 THEN '{"output": [{"content": [{"text": "' || event_type || '"}]}]}' WHEN 2 THEN '{"answer": {"text": "' || event_type || '"}}'
  WHEN 3 THEN '{"own": {"deep": "' || event_type || '"}}' WHEN 4 THEN '{"content": "", "response": ' || user_id || '}' ELSE event_type END AS raw FROM events"""


@query("SELECT event_id, CASE event_id % 6 WHEN 4 THEN '' || user_id ELSE event_type END AS text FROM events")
def response_texts(spark, d):
    """Events wrapped as responses of several providers."""
    return fx.frame(spark, d, _RESPONSES).select("event_id", requests.response_text(F.col("raw"), "own.deep").alias("text"))


@query()
def judge_requests(spark, d):
    """What a judge is shown of each answer; unsafe cases only in the abstract."""
    out = requests.abstracted(fx.answers(spark, d), F.col("suite") == "safety", "an abstract of an unsafe request", "a refusal")
    text = requests.judge_request(out, ["case_id", "question", "gold_answer", "required_conditions", "forbidden_claims"], ["status", "model_answer"])
    return out.select("case_id", "sanitized", text.alias("request"))


@query("SELECT doc_id::VARCHAR AS case_id, coalesce(nullif(trim(source), ''), 'unknown') AS qa_category, CASE WHEN doc_id % 2 = 0 THEN 'a|b c' ELSE '' END AS required, CASE WHEN nullif(trim(lang), '') IS NULL THEN 0 ELSE 1 END AS evidence, 'active' AS case_status, 'P1' AS priority FROM documents")
def canonical_cases(spark, d):
    """P2."""
    raw = fx.frame(spark, d, "SELECT doc_id AS case_id, text AS question, source AS qa_category, CASE WHEN doc_id % 2 = 0 THEN 'a; ;b c' END AS required_conditions, lang AS evidence, ' Active' AS case_status FROM documents")
    out = requests.canonical_cases(raw)
    return out.select("case_id", "qa_category", F.array_join("required_conditions", "|").alias("required"), F.size("gold_evidence").alias("evidence"), "case_status", "priority")


_ARB = _NORMAL.replace(fx.VERDICTS_SQL, fx.ARBITER_SQL).replace("v AS (", "av AS (").replace("p AS (", "ap AS (").replace("FROM v)", "FROM av)")
_MARKED = f"""{_NORMAL}, {_ARB}, bs AS (SELECT * FROM p WHERE judge_id = 'j0' AND case_id % 7 > 0), ot AS (SELECT * FROM p WHERE judge_id = 'j1' AND case_id % 11 > 0),
w AS (SELECT a.config_id, a.case_id, a.overall AS bo, b.overall AS oo, a.pass AS bp, b.pass AS op, b.overall - a.overall AS delta, abs(b.overall - a.overall) AS gap, abs(b.overall - a.overall) / greatest(abs(a.overall), 1) * 100 AS rel, a.error_type <> b.error_type AS em, ap.overall AS ao, ap.pass AS apass FROM bs a JOIN ot b USING (config_id, case_id) LEFT JOIN ap USING (config_id, case_id)),
y AS (SELECT *, rel >= 30 OR bp <> op OR em AS conflict FROM w), z AS (SELECT *, CASE WHEN NOT conflict THEN (bo + oo) / 2 ELSE ao END AS final, CASE WHEN NOT conflict THEN bp ELSE apass END AS fp FROM y)"""


def _sides(spark, d):
    v = _v(spark, d)
    from gradeflow.operators import judges

    return v.where("judge_id = 'j0' and case_id % 7 > 0"), v.where("judge_id = 'j1' and case_id % 11 > 0"), judges.normalised(fx.arbiter(spark, d))


@query(f"""WITH {_MARKED} SELECT count(*) AS matched_rows, count(*) FILTER (WHERE delta > 0) AS candidate_higher_rows, count(*) FILTER (WHERE delta < 0) AS baseline_higher_rows, count(*) FILTER (WHERE delta = 0) AS same_score_rows, count(*) FILTER (WHERE rel >= 30) AS gap_met_rows, count(*) FILTER (WHERE bp <> op) AS pass_mismatch_rows, count(*) FILTER (WHERE em) AS error_mismatch_rows,
  count(*) FILTER (WHERE conflict) AS conflict_rows, count(*) FILTER (WHERE conflict AND ao IS NOT NULL) AS arbiter_settled_rows, count(*) FILTER (WHERE conflict AND ao IS NULL) AS arbiter_missing_rows, count(final) AS final_complete_rows, count(*) FILTER (WHERE fp) AS final_pass_rows, count(*) FILTER (WHERE bp) AS baseline_pass_rows, count(*) FILTER (WHERE op) AS candidate_pass_rows,
  round(avg(bo), 6) AS baseline_avg, round(avg(oo), 6) AS candidate_avg, round(avg(delta), 6) AS avg_delta, round(avg(gap), 6) AS avg_gap, round(avg(rel), 6) AS avg_selected_gap, round(avg(final), 6) AS final_avg, round(quantile_cont(rel, 0.9), 6) AS p90_selected_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(quantile_cont(gap, 0.9), 6) AS p90_gap, round(quantile_cont(gap, 0.95), 6) AS p95_gap,
  (SELECT count(*) FROM bs) AS baseline_source_rows, (SELECT count(*) FROM ot) AS candidate_source_rows, (SELECT count(*) FROM bs ANTI JOIN ot USING (config_id, case_id)) AS missing_candidate_rows, (SELECT count(*) FROM ot ANTI JOIN bs USING (config_id, case_id)) AS missing_baseline_rows FROM z""")
def comparison_report(spark, d):
    """Two judges over different cases, an arbiter for even ones."""
    base, other, arb = _sides(spark, d)
    _, out = api.compare_judges(base, other, mode="relative_percent", threshold=30.0, arbiter=arb)
    return rounded(out, "baseline_avg", "candidate_avg", "avg_delta", "avg_gap", "avg_selected_gap", "final_avg", "p90_selected_gap", "median_gap", "p90_gap", "p95_gap")


@query(f"WITH {_MARKED} SELECT config_id, case_id FROM z WHERE conflict AND ao IS NULL")
def arbiter_keys(spark, d):
    """Conflicts that the arbiter has not seen yet."""
    base, other, arb = _sides(spark, d)
    pairs, _ = api.compare_judges(base, other, mode="relative_percent", threshold=30.0, arbiter=arb)
    return pairs.where("conflict and arbiter_score is null").select("config_id", "case_id")


@query(f"WITH {_PAIRS}, {_CASES} SELECT k.qa_topic AS value, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(gap), 6) AS mean_gap FROM w JOIN k USING (case_id) GROUP BY 1")
def comparison_by_topic(spark, d):
    """A19."""
    pairs = _pairs(spark, d).join(fx.cases(spark, d).select("case_id", "qa_topic"), "case_id")
    return rounded(compare.by_dimension(pairs, "qa_topic"), "mean_delta", "mean_gap")


@query(f"WITH {_PAIRS}, e(band, least) AS (VALUES (0, 0.0::DOUBLE), (1, 0.05), (2, 0.1), (3, 0.2), (4, 0.3)), n AS (SELECT band, least, (SELECT count(*) FROM w WHERE gap >= e.least AND gap < coalesce((SELECT min(x.least) FROM e x WHERE x.least > e.least), 99)) AS n FROM e) SELECT *, round(n / (SELECT count(*) FROM w), 9) AS rate FROM n")
def comparison_band_rates(spark, d):
    """A18."""
    return compare.band_rates(compare.bands(_pairs(spark, d), (0.0, 0.05, 0.1, 0.2, 0.3))).withColumn("rate", F.round("rate", 9))


_FIELDS = ("qa_category", "question_type", "qa_topic", "severity", "case_status", "suite", "expected_behavior", "task_type")
_MORE = "CASE WHEN active THEN 'active' ELSE 'shadow' END AS case_status, CASE WHEN severity = 'critical' THEN 'safety' ELSE 'core' END AS suite, CASE WHEN case_id % 5 = 0 THEN 'structured_output_required' ELSE '' END AS expected_behavior, CASE WHEN case_id % 3 = 0 THEN 'tool' ELSE 'qa' END AS task_type"


@query(f"WITH {_CASES}, m AS (SELECT *, {_MORE} FROM k), f AS ({' UNION ALL '.join(f"SELECT '{c}' AS field, coalesce({c}, 'unknown') AS value FROM m" for c in _FIELDS)}), n AS (SELECT field, value, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM n) SELECT * FROM r WHERE rank <= 20")
def dataset_profile_all(spark, d):
    """All eight fields."""
    return views.profile(fx.cases(spark, d).selectExpr("*", *_MORE.split(", ")), list(_FIELDS))


@query(f"WITH {_CASES} SELECT unnest(['total', 'tools', 'final_answer', 'format', 'active_gold', 'eligible', 'gold', 'review']) AS flag, unnest([count(*), count(*) FILTER (WHERE case_id % 3 = 0), count(*) FILTER (WHERE n_chars > 0), count(*) FILTER (WHERE case_id % 5 = 0), count(*) FILTER (WHERE active AND gold_verified), count(*) FILTER (WHERE gate_eligible), count(*) FILTER (WHERE gold_verified), count(*) FILTER (WHERE NOT active OR NOT gold_verified)]) AS n FROM k")
def dataset_flags(spark, d):
    """The total and seven flags."""
    i = F.col("case_id")
    flags = {"tools": i % 3 == 0, "final_answer": F.col("n_chars") > 0, "format": i % 5 == 0, "active_gold": F.col("active") & F.col("gold_verified"), "eligible": F.col("gate_eligible"), "gold": F.col("gold_verified"), "review": ~F.col("active") | ~F.col("gold_verified")}
    return views.profile_flags(fx.cases(spark, d), flags)


@query("SELECT CASE WHEN id = '' THEN 'blank' ELSE 'duplicate' END AS fault, id, n FROM (SELECT CASE WHEN o_custkey % 10 = 0 THEN '' ELSE '' || o_custkey END AS id, count(*) AS n FROM orders GROUP BY 1) WHERE id = '' OR n > 1")
def prediction_id_faults(spark, d):
    """Orders stand for predictions, customers for scenarios."""
    return views.id_faults(fx.frame(spark, d, "SELECT CASE WHEN o_custkey % 10 = 0 THEN ' ' ELSE '' || o_custkey END AS id FROM orders"), "id")


@query(f"WITH {_ROWS}, m AS (SELECT case_id % 5 AS run_id, config_id, count(*) AS n, avg(overall) AS average, avg(pass::INT) AS pass_rate, CASE WHEN bool_or(release_gate = 'block') THEN 0 WHEN bool_or(release_gate = 'review') THEN 1 ELSE 2 END AS g FROM w GROUP BY 1, 2) SELECT run_id, count(*) AS models, max(n) AS total, round(avg(average), 6) AS average, round(avg(pass_rate), 6) AS pass_rate, ['block', 'review', 'pass'][min(g) + 1] AS worst_gate, run_id * 2 AS started_at FROM m GROUP BY 1")
def run_list(spark, d):
    """Fifths of the cases stand for runs."""
    r = rows(spark, d)
    gate = F.min_by("release_gate", F.struct(views.gate_rank(F.col("release_gate")), "release_gate"))
    per = r.groupBy((F.col("case_id") % 5).alias("run_id"), "config_id").agg(F.count("*").alias("n"), F.avg("overall").alias("average"), F.avg(F.col("pass").cast("int")).alias("pass_rate"), gate.alias("release_gate"))
    return rounded(views.run_list(per.withColumn("started_at", F.col("run_id") * 2)), "average", "pass_rate")


@query(f"WITH {_ROWS}, cl AS (SELECT qa_topic, coalesce(question_type, 'unknown') AS question_type, config_id, count(*) AS n, count(DISTINCT case_id) AS cases, round(avg(overall), 9) AS average, round(avg(pass::INT), 9) AS pass_rate FROM w GROUP BY 1, 2, 3) SELECT *, CASE WHEN cases >= 5 THEN 'reliable' ELSE 'low_sample' END AS reliability FROM cl")
def benchmark_cells(spark, d):
    """All cells of three dimensions, weakest first."""
    out = views.weakest_cells(rows(spark, d), ("qa_topic", "question_type", "config_id"), most=100_000)
    return out.withColumns({c: F.round(c, 9) for c in ("average", "pass_rate")})


@query("WITH " + SQL["slice_scores"].removeprefix("WITH ").replace("SELECT config_id, concat_ws(' x '", "SELECT config_id, 3 - ga - gb - gc AS level, concat_ws(' x '"))
def slices_in_order(spark, d):
    """K10, A4, A12."""
    out = review.slices_in_order(tables.slices(_s(spark, d), fx.cases(spark, d))).withColumns({c: F.round(c, 9) for c in ("overall", "pass_rate")})
    return out.select("config_id", "level", "dimension", "value", "case_count", "row_count", "overall", "pass_rate", "reliability")


@query(SQL["release_gates"].replace("ELSE 'pass' END AS release_gate FROM r", "ELSE 'pass' END AS release_gate, CASE WHEN gate_eligible_cases = 0 THEN 'no gate-eligible cases' WHEN block_count > 0 AND coalesce(core < 0.5, false) THEN 'block_cases=' || block_count || '; core_pass_rate below minimum' WHEN block_count > 0 THEN 'block_cases=' || block_count WHEN coalesce(core < 0.5, false) THEN 'core_pass_rate below minimum' WHEN review_count > 0 THEN 'review_cases=' || review_count ELSE 'all case gates passed' END AS reason FROM r"))
def release_gates_reasoned(spark, d):
    """The gate table, worst gate first, with reasons."""
    scores = _s(spark, d).withColumn("error_type", F.lit("normal"))
    out = tables.release_gates(scores, fx.cases(spark, d), F.col("qa_topic") == "long", 0.5, F.col("agreement_status") == "review_needed")
    return rounded(review.gates_in_order(out), "core_pass_rate")


@query(f"WITH a AS ({fx.ANSWERS_SQL}), s AS (SELECT lang AS config_id, status, n_chars::DOUBLE AS latency FROM a) SELECT config_id, round(avg(latency) FILTER (WHERE status = 'ok'), 6) AS avg_latency_ms, count(*) FILTER (WHERE status = 'ok') AS ok_answers FROM s GROUP BY 1")
def latency_by_model(spark, d):
    """A1: languages stand for models, lengths for latencies."""
    out = fx.answers(spark, d).select(F.col("lang").alias("config_id"), "status", F.col("n_chars").cast("double").alias("latency_ms"))
    return rounded(tables.latency_means(out), "avg_latency_ms")


@query("""WITH o AS (SELECT doc_id, text, source, lang, substr(sha256('{"case_id":' || doc_id || ',"config_id":"m1","prompt":null,"question":' || coalesce(to_json(lang)::VARCHAR, 'null') || '}'), 1, 24) AS output_fingerprint FROM documents)
SELECT doc_id, output_fingerprint, substr(sha256('{"model":"big","prompt":"p","provider":' || coalesce(to_json(source)::VARCHAR, 'null') || ',"question":' || coalesce(to_json(lang)::VARCHAR, 'null') || '}'), 1, 24) AS answer_cache_key,
  substr(sha256('{"answer":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"judge_id":"j0","output_fingerprint":"' || output_fingerprint || '","prompt_hash":"h"}'), 1, 24) AS judge_cache_key,
  substr(sha256('{"judges":["j0","j1"],"mode":"blend","output_fingerprint":"' || output_fingerprint || '","threshold":0.6,"weight":0.5}'), 1, 24) AS score_fingerprint FROM o""")
def fingerprints(spark, d):
    """All four."""
    lit = F.lit
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("output_fingerprint", facts.output_fingerprint(lit("m1"), F.col("doc_id"), F.col("lang"), lit(None).cast("string")))
    keys = {"answer_cache_key": facts.answer_cache_key(F.col("source"), lit("big"), lit("p"), F.col("lang")), "judge_cache_key": facts.judge_cache_key(lit("j0"), lit("h"), F.col("output_fingerprint"), F.col("lang")), "score_fingerprint": facts.score_fingerprint(F.col("output_fingerprint"), lit("blend"), lit(0.5), lit(0.6), F.array(lit("j1"), lit("j0")))}
    return docs.withColumns(keys).select("doc_id", "output_fingerprint", *keys)


@query(f"SELECT config_id, case_id, judge_id, run FROM ({_RUNS}) WHERE lower(status) IN ('ok', 'refused_by_provider_policy') AND judge_id <> 'j2'")
def resumable_verdicts(spark, d):
    """finished rows of judges whose prompt is still the one wanted."""
    held = runs(spark, d).withColumn("prompt_hash", F.when(F.col("judge_id") == "j2", "old").otherwise("new"))
    wanted = fx.frame(spark, d, f"SELECT DISTINCT judge_id, 'new' AS prompt_hash FROM ({fx.VERDICTS_SQL})")
    return merge.resumable(held, wanted).select("config_id", "case_id", "judge_id", "run")


@query(f"WITH {_CONSENSUS}, {_CASES} SELECT s.config_id, s.case_id, k.qa_category, k.qa_topic, k.gold_verified, s.critical_fail, round(s.overall, 6) AS overall, CASE WHEN s.pass THEN 'Pass' ELSE 'Fail' END AS pass_fail, round(1 - s.hal_pass, 6) AS hal_rate, k.n_chars AS size, substr(trim(regexp_replace(d.text, '{WS}', ' ', 'g')), 1, 700) AS answer_excerpt FROM s JOIN k USING (case_id) JOIN documents d ON d.doc_id = s.case_id")
def wide_question_cases(spark, d):
    """P24, J3."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("case_id"), F.col("text").alias("model_answer"))
    fact = _s(spark, d).join(fx.cases(spark, d), "case_id").join(docs, "case_id")
    out = facts.wide_cases(fact).join(fx.cases(spark, d).select("case_id", F.col("n_chars").alias("size")), "case_id")
    return rounded(out.select("config_id", "case_id", "qa_category", "qa_topic", "gold_verified", "critical_fail", "overall", "pass_fail", "hal_rate", "size", "answer_excerpt"), "overall", "hal_rate")


@query(f"WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g')) AS t FROM documents), p AS (SELECT doc_id, t, [trim(x) FOR x IN regexp_split_to_array(t, '[\\n\\r.!?。！？;；]+') IF trim(x) <> ''] AS p FROM s) SELECT doc_id, CASE WHEN len(p) > 0 THEN len(p) WHEN t <> '' THEN 1 ELSE 0 END AS sentences, coalesce(nullif(p[1], ''), t) AS first, len(list_distinct([x FOR x IN string_split(t, ' ') IF x <> ''])) AS tokens, upper(substr(sha1(t), 1, 12)) AS sha FROM p")
def sentences_and_tokens(spark, d):
    """2.8: sentence split, token set, sha1, over every whole text."""
    from gradeflow.functions.columns import squeezed

    t = squeezed(F.coalesce("text", F.lit("")))
    parts = textsim.sentences(F.col("text"))
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("t", t)
    return docs.select("doc_id", F.size(F.coalesce(parts, F.array().cast("array<string>"))).alias("sentences"), F.coalesce(F.get(parts, F.lit(0)), "t").alias("first"), F.size(textsim.tokens(F.col("t"))).alias("tokens"), F.upper(F.substring(F.sha1("t"), 1, 12)).alias("sha"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS version, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS seoul_day FROM events")
def event_times(spark, d):
    """2.8: times as version text, and the day in Seoul."""
    # plain times without a zone, so the session's zone plays no part
    day = F.date_format(F.expr("ts + INTERVAL 9 HOURS"), "yyyy-MM-dd")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("version"), day.alias("seoul_day"))


_NESTED = """SELECT doc_id, source, lang, n_chars, CASE WHEN doc_id % 2 = 0 THEN '{"source": {"name": "' || source || '", "chars": ' || n_chars || '},  "lang": ["' || lang || '", null, true, {}]}' ELSE '{"lang": ["' || lang || '",null,true,{}], "source": {"chars": ' || n_chars || ', "name":"' || source || '"}}' END AS doc FROM documents"""


@query(f"""SELECT doc_id, substr(sha256('{{"lang":["' || lang || '",null,true,{{}}],"source":{{"chars":' || n_chars || ',"name":"' || source || '"}}}}'), 1, 24) AS fingerprint,
  CASE WHEN source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL THEN concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN concat_ws(' ', nullif(trim(source), ''), nullif(n_chars, 0)) END, nullif(trim(lang), ''), 'True', CASE WHEN doc_id % 2 = 1 THEN concat_ws(' ', nullif(n_chars, 0), nullif(trim(source), '')) END) END AS said FROM documents""")
def nested_fingerprints(spark, d):
    """P45, 2.8: nested JSON in two orders of names has one fingerprint; its values as text."""
    return fx.frame(spark, d, _NESTED).select("doc_id", json_fingerprint(F.col("doc")).alias("fingerprint"), json_as_text(F.col("doc")).alias("said"))


#: Brands stand for datasets: the last digit says whether one is listed or only found, the other its role.
_BRANDS = "SELECT p_brand, CASE substr(p_brand, 7, 1) WHEN '1' THEN 'benchmark' WHEN '2' THEN 'custom' ELSE 'regression' END AS role, substr(p_brand, 8, 1) AS k, count(*) AS n FROM part GROUP BY p_brand"
_LISTED = f"SELECT 'L' || p_brand AS dataset_id, 'files/' || p_brand AS path, role, CASE WHEN p_brand = 'Brand#21' THEN false END AS gate_eligible, CASE WHEN p_brand = 'Brand#11' THEN false END AS registered, 5 AS quota FROM ({_BRANDS}) AS b WHERE k = '1'"
_FOUND = f"SELECT p_brand AS dataset_id, 'files/' || p_brand AS path, role FROM ({_BRANDS}) AS b"
_SIZES = f"SELECT 'files/' || p_brand AS path, CASE WHEN k = '5' THEN 0 WHEN p_brand = 'Brand#11' THEN 0 ELSE n END AS rows FROM ({_BRANDS}) AS b"
_POOLS = f"""l AS ({_LISTED}), fo AS ({_FOUND}), z AS ({_SIZES}),
r AS (SELECT dataset_id, l.path, role, false AS discovered, coalesce(nullif(rows, 0), quota)::BIGINT AS quota, coalesce(gate_eligible, role <> 'benchmark') AS gate_eligible, coalesce(registered, true) AS registered, NULL AS status_default FROM l LEFT JOIN z ON z.path = l.path
  UNION ALL SELECT dataset_id, fo.path, role, true, rows::BIGINT, role <> 'benchmark', true, CASE role WHEN 'regression' THEN 'active' ELSE 'shadow' END FROM fo JOIN z ON z.path = fo.path WHERE fo.path NOT IN (SELECT path FROM l))"""
_CHOSEN = {"regression": "Brand#5", "benchmark": "Brand#5"}


def _pools(spark, d):
    return compose.runtime_pools(*(fx.frame(spark, d, q) for q in (_LISTED, _FOUND, _SIZES)))


@query(f"WITH {_POOLS} SELECT dataset_id, role, discovered, quota, gate_eligible, registered, status_default FROM r")
def runtime_pools(spark, d):
    """Pools as listed and as found, what they leave open inherited."""
    return _pools(spark, d).select("dataset_id", "role", "discovered", "quota", "gate_eligible", "registered", "status_default")


@query(f"""WITH {_POOLS}, m AS (SELECT role, arg_min(dataset_id, CASE WHEN role = 'regression' AND dataset_id = 'Brand#5' THEN '0' ELSE '2' || dataset_id END) AS dataset_id FROM r WHERE quota > 0 GROUP BY role)
SELECT 'default_' || role AS profile_id, dataset_id, quota FROM m JOIN r USING (role, dataset_id) UNION ALL SELECT 'registered_' || role || '_all', dataset_id, quota FROM r WHERE quota > 0 AND registered""")
def runtime_profiles(spark, d):
    """The default pool of each role and all registered ones."""
    pools = _pools(spark, d)
    return compose.profiles(pools, compose.role_defaults(pools, _CHOSEN)).select("profile_id", "dataset_id", "quota")
