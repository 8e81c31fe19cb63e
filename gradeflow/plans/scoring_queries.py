"""Queries of payload checks and of scoring by rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions.columns import ERROR_TYPES, OTHER_NAMES
from gradeflow.operators import payloads, scoring, textsim
from gradeflow.plans import fixtures as fx
from gradeflow.plans.queries import WS, grams_sql, query

_NAMES = {n: target for target, others in OTHER_NAMES.items() for n in others}
_COMPACT = "regexp_replace(regexp_replace(lower({0}), '[\\s-]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _map(names: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"


_WHOLE = {n: f"""CASE WHEN json_type(j, '$.scores.{n}') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(j, '$.scores.{n}')::BIGINT
  WHEN json_type(j, '$.scores.{n}') = 'DOUBLE' AND json_extract_string(j, '$.scores.{n}')::DOUBLE = floor(json_extract_string(j, '$.scores.{n}')::DOUBLE) THEN json_extract_string(j, '$.scores.{n}')::DOUBLE::BIGINT
  WHEN json_type(j, '$.scores.{n}') = 'VARCHAR' THEN TRY_CAST(trim(json_extract_string(j, '$.scores.{n}')) AS BIGINT) END AS {n}""" for n in payloads.RAW_SCORES}
_TOP = "['scores', " + ", ".join(f"'{f}'" for f in payloads.FIELDS) + "]"
_INNER = "[" + ", ".join(f"'{f}'" for f in payloads.RAW_SCORES) + "]"


def _lacking(title: str, a: str, b: str) -> str:
    return f"CASE WHEN len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0 THEN '{title}' || array_to_string(list_filter({a}, lambda x: NOT list_contains({b}, x)), ', ') END"


_CHECKED = f"""o AS (SELECT *, nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS obj FROM ({fx.PAYLOADS_SQL})),
q AS (SELECT *, CASE WHEN json_valid(obj) THEN obj::JSON END AS j FROM o),
w AS (SELECT *, json_keys(j) AS top, coalesce(json_keys(j, '$.scores'), []) AS ins, {", ".join(_WHOLE.values())}, trim(regexp_replace(json_extract_string(j, '$.error_type'), '\\s+', ' ', 'g')) AS et, trim(regexp_replace(json_extract_string(j, '$.reason'), '\\s+', ' ', 'g')) AS said FROM q),
c AS (SELECT *, coalesce(CASE WHEN j IS NULL THEN 'no JSON object' END, CASE WHEN coalesce(json_type(j, '$.scores'), '') <> 'OBJECT' THEN 'no object of scores' END,
  {_lacking("missing fields: ", _TOP, "top")}, {_lacking("unexpected fields: ", "top", _TOP)}, {_lacking("missing scores: ", _INNER, "ins")}, {_lacking("unexpected scores: ", "ins", _INNER)},
  {", ".join(f"CASE WHEN {n} IS NULL OR {n} NOT IN ({', '.join(map(str, ok))}) THEN '{n} is not one of {', '.join(map(str, ok))}' END" for n, ok in payloads.RAW_SCORES.items())},
  CASE WHEN json_type(j, '$.critical_fail') <> 'BOOLEAN' THEN 'critical_fail is not boolean' END,
  CASE WHEN coalesce(et, '') = '' OR NOT (list_contains(map_keys({_map(_NAMES)}), et) OR list_contains(map_keys({_map(_NAMES)}), {_COMPACT.format("et")}) OR {_COMPACT.format("et")} IN {ERROR_TYPES}) THEN 'unknown error type' END,
  CASE WHEN coalesce(said, '') = '' THEN 'no reason' END, CASE WHEN json_type(j, '$.evidence_notes') <> 'ARRAY' THEN 'notes are no list' END) AS invalid FROM w),
chk AS (SELECT config_id, case_id, judge_id, seq, raw, invalid, {", ".join(f"CASE WHEN invalid IS NULL THEN {n} END AS {n}" for n in payloads.RAW_SCORES)},
  CASE WHEN invalid IS NULL THEN json_extract_string(j, '$.critical_fail')::BOOLEAN END AS critical_fail,
  CASE WHEN invalid IS NULL THEN coalesce({_map(_NAMES)}[et], {_map(_NAMES)}[{_COMPACT.format("et")}], {_COMPACT.format("et")}) END AS error_type, CASE WHEN invalid IS NULL THEN said END AS reason,
  CASE WHEN invalid IS NULL THEN least(1, json_extract_string(j, '$.confidence')::DOUBLE) END AS confidence, CASE WHEN invalid IS NULL THEN 'one|two three' END AS notes FROM c)"""


@query(f"WITH {_CHECKED} SELECT config_id, case_id, judge_id, invalid, accuracy, completeness, numerical_accuracy, hallucination, critical_fail, error_type, reason, confidence, notes FROM chk")
def judge_payloads_checked(spark, d):
    """P15, P16, P13."""
    out = payloads.checked(fx.payloads(spark, d))
    return out.select("config_id", "case_id", "judge_id", "invalid", *payloads.RAW_SCORES, "critical_fail", "error_type", "reason", "confidence", F.array_join("evidence_notes", "|").alias("notes"))


@query(f"WITH {_CHECKED}, s AS (SELECT config_id, case_id, judge_id, CASE WHEN invalid IS NULL THEN 'ok' ELSE 'invalid' END AS status, coalesce(invalid, reason) AS reason, raw FROM chk WHERE invalid IS NULL OR case_id % 2 = 0) SELECT *, substr(raw, 1, 700) AS excerpt FROM s")
def judge_raw_responses(spark, d):
    """Good responses, and the invalid ones of even cases."""
    out = payloads.checked(fx.payloads(spark, d))
    status = F.when(F.col("invalid").isNull(), "ok").otherwise("invalid")
    both = out.where("invalid is null or case_id % 2 = 0").withColumns({"status": status, "reason": F.coalesce("invalid", "reason")})
    return payloads.responses(both)


@query(f"WITH {_CHECKED} SELECT invalid AS reason, count(*) AS n, count(DISTINCT case_id) AS cases FROM chk WHERE invalid IS NOT NULL GROUP BY 1")
def judge_failures_by_reason(spark, d):
    """P23, P16."""
    out = payloads.checked(fx.payloads(spark, d)).where("invalid is not null")
    failed = payloads.failures(out.select(*payloads.KEY, "judge_id", F.lit(None).cast("string").alias("status"), F.col("invalid").alias("reason")))
    return failed.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))


#: Order lines as verdict items: raw scores for some, percents and fractions as text for others.
_ITEMS = """SELECT l_orderkey AS case_id, l_linenumber AS seq,
  CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 2 + 1 END AS accuracy, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 4 - 1 END AS completeness,
  CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 3 - l_linenumber % 2 END AS numerical_accuracy, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 2 END AS hallucination,
  CASE WHEN l_orderkey % 3 = 1 THEN '0.' || (l_linenumber % 10) WHEN l_orderkey % 3 = 2 THEN '' || (l_partkey % 101) END AS acc, CASE l_linenumber % 3 WHEN 0 THEN '80' WHEN 1 THEN 'n/a' END AS com,
  CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE '0.5' END AS nac, CASE WHEN l_orderkey % 5 > 0 THEN '1' END AS hal_pass,
  CASE l_orderkey % 4 WHEN 0 THEN 'acc, hal_pass' WHEN 1 THEN 'acc,com,style' END AS applicable_metrics, CASE WHEN l_orderkey % 13 = 0 THEN 'Yes' WHEN l_orderkey % 13 = 1 THEN 'no' END AS critical_fail FROM lineitem"""
_SCORE01 = "least(1, greatest(0, CASE WHEN TRY_CAST({0} AS DOUBLE) > 1 THEN TRY_CAST({0} AS DOUBLE) / 100 ELSE TRY_CAST({0} AS DOUBLE) END))"


def _score(m: str) -> str:
    return f"CASE WHEN TRY_CAST({m} AS DOUBLE) IS NOT NULL THEN {_SCORE01.format(m)} END"


_EVERY = "['acc', 'com', 'nac', 'hal_pass']"


@query(f"""WITH i AS ({_ITEMS}), r AS (SELECT case_id, seq, applicable_metrics, coalesce(lower(critical_fail) = 'yes', false) AS critical_fail, accuracy IS NOT NULL AS raw, completeness, numerical_accuracy,
  CASE WHEN accuracy IS NOT NULL THEN accuracy / 2.0::DOUBLE ELSE {_score("acc")} END AS acc, CASE WHEN accuracy IS NULL THEN {_score("com")} WHEN completeness >= 0 THEN completeness / 2.0::DOUBLE END AS com,
  CASE WHEN accuracy IS NULL THEN {_score("nac")} WHEN numerical_accuracy >= 0 THEN numerical_accuracy::DOUBLE END AS nac, CASE WHEN accuracy IS NULL THEN {_score("hal_pass")} ELSE (1 - hallucination)::DOUBLE END AS hal_pass FROM i),
l AS (SELECT *, list_filter([trim(x) FOR x IN string_split(coalesce(applicable_metrics, ''), ',')], lambda x: list_contains({_EVERY}, x)) AS given,
  list_filter(['acc', CASE WHEN completeness >= 0 THEN 'com' END, CASE WHEN numerical_accuracy >= 0 THEN 'nac' END, 'hal_pass'], lambda x: x IS NOT NULL) AS of_raw,
  list_filter([CASE WHEN acc IS NOT NULL THEN 'acc' END, CASE WHEN com IS NOT NULL THEN 'com' END, CASE WHEN nac IS NOT NULL THEN 'nac' END, CASE WHEN hal_pass IS NOT NULL THEN 'hal_pass' END], lambda x: x IS NOT NULL) AS present FROM r),
a AS (SELECT *, CASE WHEN len(given) > 0 THEN given WHEN raw THEN of_raw WHEN len(present) > 0 THEN present ELSE {_EVERY} END AS ap FROM l),
m AS (SELECT case_id, seq, critical_fail, array_to_string(ap, ',') AS applicable_metrics, list_filter({_EVERY}, lambda x: list_contains(ap, x) AND NOT list_contains(present, x)) AS lacks, {", ".join(f"CASE WHEN list_contains(ap, '{x}') THEN {x} END AS {x}" for x in ("acc", "com", "nac", "hal_pass"))} FROM a),
v AS (SELECT case_id, seq, applicable_metrics, critical_fail, CASE WHEN len(lacks) > 0 THEN 'no value: ' || array_to_string(lacks, ', ') END AS invalid, acc, com, nac, hal_pass, CASE WHEN len(lacks) = 0 THEN (coalesce(acc, 0) + coalesce(com, 0) + coalesce(nac, 0) + coalesce(hal_pass, 0)) / (count_if_not_null) END AS overall
  FROM (SELECT *, (acc IS NOT NULL)::INT + (com IS NOT NULL)::INT + (nac IS NOT NULL)::INT + (hal_pass IS NOT NULL)::INT AS count_if_not_null FROM m))
SELECT case_id, seq, applicable_metrics, invalid, acc, com, nac, hal_pass, round(overall, 9) AS overall, overall >= 0.6 AND NOT critical_fail AS pass FROM v""")
def items_as_verdicts(spark, d):
    """P19, P20, P21, P14."""
    out = payloads.item_verdicts(fx.frame(spark, d, _ITEMS))
    return out.select("case_id", "seq", "applicable_metrics", "invalid", "acc", "com", "nac", "hal_pass", F.round("overall", 9).alias("overall"), "pass")


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


@query(f"""WITH p AS (SELECT case_id, {_squeezed("model_answer")} AS a, {_squeezed("gold_answer")} AS r FROM ({fx.ANSWERS_SQL})),
pt AS (SELECT case_id, a AS t, 0 AS k FROM p WHERE a <> '' UNION ALL SELECT case_id, trim(x) AS t, k FROM (SELECT case_id, unnest(regexp_split_to_array(a, '[\n\r.!?。！？;；]+')) AS x, unnest(range(1, len(regexp_split_to_array(a, '[\n\r.!?。！？;；]+')) + 1)) AS k FROM p) WHERE trim(x) <> ''),
tk AS (SELECT case_id, list_distinct(list_filter(string_split(r, ' '), lambda x: length(x) > 1)) AS w FROM p),
ov AS (SELECT case_id, k, coalesce(len(list_intersect(w, string_split(t, ' '))) / nullif(len(w), 0)::DOUBLE, 0) AS o FROM pt JOIN tk USING (case_id)),
tx AS (SELECT case_id, k, 'l' AS side, lower(replace(t, ' ', '')) AS t FROM pt UNION ALL SELECT case_id, -1, 'r', lower(replace(r, ' ', '')) FROM p), {grams_sql("tx", "case_id, k")},
nm AS (SELECT case_id, k, side, n, sqrt(sum(m * m)) AS norm FROM gc GROUP BY ALL),
dt AS (SELECT a.case_id, a.k, a.n, sum(a.m * b.m)::DOUBLE AS dot FROM gc a JOIN gc b ON a.case_id = b.case_id AND a.n = b.n AND a.g = b.g AND a.side = 'l' AND b.side = 'r' GROUP BY ALL),
cs AS (SELECT dt.case_id, max(dot / (x.norm * y.norm)) AS c FROM dt JOIN nm x ON x.case_id = dt.case_id AND x.k = dt.k AND x.n = dt.n AND x.side = 'l' JOIN nm y ON y.case_id = dt.case_id AND y.n = dt.n AND y.side = 'r' GROUP BY 1),
s AS (SELECT p.case_id, CASE WHEN r = '' OR a = '' THEN 0 WHEN contains(lower(replace(a, ' ', '')), lower(replace(r, ' ', ''))) THEN 1 ELSE least(1, greatest(coalesce(c, 0), coalesce((SELECT max(o) FROM ov WHERE ov.case_id = p.case_id), 0))) END AS x FROM p LEFT JOIN cs USING (case_id))
SELECT s.case_id, round_even(100 * coalesce(o, 0), 2) AS overlap, round_even(100 * x, 2) AS similarity FROM s LEFT JOIN ov ON ov.case_id = s.case_id AND ov.k = 0""")
def answer_similarity(spark, d):
    """Each whole document against a passage of the benchmark."""
    pairs = fx.answers(spark, d).select("case_id", "model_answer", F.array("gold_answer").alias("wanted"))
    # the work is in the texts, so rows are dealt to all tasks whatever the files' sizes
    out = textsim.with_similarities(pairs.repartition(spark.sparkContext.defaultParallelism), "model_answer", "wanted", "s")
    return out.select("case_id", *[F.get("s", F.lit(0))[c].alias(c) for c in ("overlap", "similarity")])


@query()
def answers_scored(spark, d):
    """T13 with T4-T12 and P49, over every document as an answer."""
    out = scoring.scored(fx.answers(spark, d).repartition(spark.sparkContext.defaultParallelism))
    return out.select("case_id", "acc", "com", "nac", "hal_pass", "overall_score", "pass", "critical_fail", "error_type", "reason", "correctness", "completeness", "retrieval_precision", "numeric_accuracy", "format_compliance", "hallucination_control", "required_score")


_MARKS = lambda names, c: " OR ".join(f"contains({c}, '{m}')" for m in names)


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_squeezed("text")} AS s FROM documents)
SELECT doc_id, {_MARKS(scoring.REFUSAL_MARKERS, "t")} AS refusal, {_MARKS(scoring.CLARIFYING_MARKERS, "t")} AS clarifying, {_MARKS(scoring.ECHO_MARKERS, "s")} OR (starts_with(s, '[') AND contains(substr(s, 1, 800), 'URL:') AND ({_MARKS(scoring.ECHO_LABELS, "substr(s, 1, 800)")})) AS echo FROM t""")
def answer_behaviour(spark, d):
    """T11."""
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scoring.is_refusal(t).alias("refusal"), scoring.is_clarifying(t).alias("clarifying"), scoring.is_echo(t).alias("echo"))


@query(f"""WITH r AS (SELECT config_id, case_id, judge_id, raw, trim(raw, ' ' || chr(10)) AS t FROM ({fx.PAYLOADS_SQL})),
f AS (SELECT *, CASE WHEN NOT contains(t, '```') THEN t WHEN regexp_full_match(t, '(?is)```(?:json)?\\s*.*?\\s*```') THEN trim(regexp_extract(t, '(?is)^```(?:json)?\\s*(.*?)\\s*```$', 1), ' ' || chr(10)) END AS b FROM r),
o AS (SELECT *, nullif(regexp_extract(b, '(?s)\\{{.*\\}}'), '') AS x FROM f), j AS (SELECT *, CASE WHEN x = b AND json_valid(x) THEN x::JSON END AS j FROM o)
SELECT config_id, case_id, judge_id, coalesce(j IS NOT NULL AND NOT contains(raw, '```') AND len(list_filter({_TOP}, lambda k: NOT list_contains(json_keys(j), k))) = 0 AND len(list_filter(json_keys(j), lambda k: NOT list_contains({_TOP}, k))) = 0, false) AS exact,
  coalesce(j IS NOT NULL AND list_contains(json_keys(j), 'reason'), false) AS loose, coalesce(j IS NOT NULL AND coalesce(json_type(j, '$.scores') = 'OBJECT', true) AND coalesce(json_type(j, '$.critical_fail') = 'BOOLEAN', true), false) AS typed FROM j""")
def structured_answers(spark, d):
    """T12, over the judges' raw answers."""
    raw, top = F.col("raw"), F.array(*[F.lit(x) for x in ("scores", *payloads.FIELDS)])
    exact = scoring.valid_json(raw, keys=top, exact=True, surrounded=False, fenceless=True)
    loose = scoring.valid_json(raw, keys=F.array(F.lit("reason")), surrounded=False)
    typed = scoring.valid_json(raw, surrounded=False, types={"scores": "object", "critical_fail": "boolean"})
    return fx.payloads(spark, d).select("config_id", "case_id", "judge_id", exact.alias("exact"), loose.alias("loose"), typed.alias("typed"))


@query()
def numbers_in_texts(spark, d):
    """The numbers and codes of each whole text, and whether numerical accuracy is full by default."""
    out = fx.answers(spark, d)
    none = F.array().cast("array<string>")
    return out.select("case_id", F.array_join(textsim.numbers(F.col("model_answer")), "|").alias("numbers"), payloads.nac_defaults_full(F.col("question_type"), F.col("gold_answer"), F.coalesce("required_conditions", none), F.col("model_answer")).alias("full"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_similarity(spark, d):
    """T4: each vector with the next one."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    both = e.alias("a").join(e.alias("b"), F.expr("b.vec_id = a.vec_id + 1"))
    return both.select("a.vec_id", F.round(textsim.vector_cosine(F.col("a.embedding"), F.col("b.embedding")), 9).alias("cosine"))
