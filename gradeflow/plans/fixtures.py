"""Cases, verdicts and scores derived from the given tables by integer arithmetic, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERDICTS = """
SELECT 'm' || k AS config_id, d AS case_id, 'j' || j AS judge_id, j AS seq,
  CASE WHEN flip = 0 THEN 2 - a0 ELSE a0 END AS accuracy,
  CASE WHEN d % 5 = 0 THEN -1 WHEN f2 = 0 THEN 0 ELSE c0 END AS completeness,
  CASE WHEN d % 3 = 0 THEN -1 WHEN flip = 0 THEN 1 - n0 ELSE n0 END AS numerical_accuracy,
  CASE WHEN f2 = 1 THEN 1 - h0 ELSE h0 END AS hallucination,
  ((d + k) % 17 = 0 AND j = 0) AS critical_fail,
  CASE WHEN a0 = 2 THEN 'normal' WHEN flip = 0 THEN 'unsupported_claim' ELSE 'partial_inaccuracy' END AS error_type
FROM (SELECT *,
    CASE WHEN m < 20 + 12 * k THEN 2 WHEN m < 50 + 10 * k THEN 1 ELSE 0 END AS a0,
    CASE WHEN m < 30 + 10 * k THEN 2 WHEN m < 60 + 8 * k THEN 1 ELSE 0 END AS c0,
    CASE WHEN m < 40 + 10 * k THEN 1 ELSE 0 END AS n0,
    CASE WHEN m < 60 + 8 * k THEN 0 ELSE 1 END AS h0
  FROM (SELECT d, k, j, (31 * d + 17 * k) % 100 AS m, (7 * d + 13 * j + 3 * k) % 10 AS flip, (3 * d + 11 * j + 5 * k) % 13 AS f2
    FROM (SELECT doc_id AS d, r_regionkey AS k, j FROM documents CROSS JOIN region CROSS JOIN (VALUES {judges}) AS judges(j)))) AS raw
"""
#: The judges' verdicts, and the arbiter's on even cases.
VERDICTS_SQL = _VERDICTS.format(judges="(0), (1), (2)")
ARBITER_SQL = f"SELECT * FROM ({_VERDICTS.format(judges='(9)')}) AS arb WHERE case_id % 2 = 0"
CASES_SQL = """
SELECT d.doc_id AS case_id, d.source AS qa_category, d.lang AS question_type,
  CASE WHEN d.n_chars < 1000 THEN 'short' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'long' END AS qa_topic,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'critical' ELSE 'normal' END AS severity,
  l.doc_id IS NOT NULL AS active, coalesce(l.quality, 0) = 1 AS gold_verified, d.n_chars AS n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


#: Raw answers of the judges: every verdict as JSON, most of them odd or wrong in one way. ``{s}`` is the type of text.
_PAYLOADS = """
SELECT config_id, case_id, judge_id, seq, v, CASE v
  WHEN 1 THEN 'Here it is: ' || body || ' - that is all.' WHEN 2 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN 11 THEN 'no verdict today' WHEN 12 THEN replace(body, '{{"accuracy"', '[{{"accuracy"') WHEN 13 THEN '[1, 2]' ELSE body END AS raw
FROM (SELECT *, '{{"scores": ' || CASE WHEN v = 14 THEN '"none"' ELSE '{{"accuracy": ' || CASE v WHEN 0 THEN '" ' || accuracy || ' "' WHEN 3 THEN accuracy || '.0' WHEN 4 THEN 'true' WHEN 5 THEN '3' WHEN 15 THEN accuracy || '.5' WHEN 16 THEN 'null' ELSE '' || accuracy END || ', "completeness": ' || completeness
    || ', "numerical_accuracy": ' || numerical_accuracy || CASE WHEN v = 17 THEN '' ELSE ', "hallucination": ' || hallucination END || CASE WHEN v = 18 THEN ', "style": 1' ELSE '' END || '}}' END
  || ', "critical_fail": ' || CASE WHEN v = 19 THEN '"no"' WHEN critical_fail THEN 'true' ELSE 'false' END
  || ', "error_type": "' || CASE v WHEN 6 THEN 'what?' WHEN 20 THEN 'Incomplete Information' WHEN 21 THEN ' typo ' ELSE error_type END || '", "reason": "' || CASE WHEN v = 7 THEN '  ' ELSE 'as  judged by ' || judge_id END || '"'
  || CASE WHEN v = 9 THEN '' ELSE ', "confidence": ' || CASE WHEN v = 22 THEN '7' ELSE '0.7' END END || ', "evidence_notes": ' || CASE WHEN v = 8 THEN '"one"' ELSE '["one", " ", "two  three"]' END || CASE WHEN v = 10 THEN ', "style": 1' ELSE '' END || '}}' AS body
  FROM (SELECT *, (case_id + 3 * seq + 5 * CAST(substr(config_id, 2) AS INT)) % 24 AS v FROM ({verdicts}) AS w) AS x) AS y
"""
PAYLOADS_SQL = _PAYLOADS.format(verdicts=VERDICTS_SQL)
#: Each document as an answer to a case whose gold answer and evidence are a passage of the benchmark.
_ANSWERS = """
SELECT d.doc_id AS case_id, d.text AS model_answer, b.text AS gold_answer, d.source, d.lang, d.n_chars,
  CASE WHEN d.doc_id % 23 = 0 THEN 'timeout_or_unreachable' ELSE 'ok' END AS status, CASE WHEN d.doc_id % 46 = 0 THEN 'no reply' END AS error,
  CASE d.doc_id % 5 WHEN 0 THEN 'Give JSON' ELSE 'What is it?' END AS question, CASE WHEN coalesce(l.toxic, 0) = 1 OR d.doc_id % 11 = 0 THEN 'safety' ELSE 'core' END AS suite,
  CASE d.doc_id % 4 WHEN 0 THEN 'amount' WHEN 1 THEN d.lang ELSE 'fact' END AS question_type, CASE d.doc_id % 7 WHEN 0 THEN 'ask_clarifying_question' WHEN 1 THEN 'abstain_when_unsupported' ELSE '' END AS expected_behavior
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
ANSWERS_SQL = _ANSWERS


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables of ``sf_dir`` that it names."""
    names = ("benchmark", "pages", "documents", "labels", "region", "events", "conversations", "embeddings", "lineitem", "part", "orders", "supplier", "customer")
    return _with_views(spark, sf_dir, sql, names)


def _with_views(spark: SparkSession, sf_dir: str, sql: str, names: tuple) -> DataFrame:
    for n in names:
        if n in sql:
            spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return spark.sql(sql)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, VERDICTS_SQL)


def arbiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, ARBITER_SQL)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, CASES_SQL).withColumn("gate_eligible", F.col("active") & F.col("gold_verified"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, PAYLOADS_SQL)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with all that the scorer reads; lists hold the source, a word and a passage."""
    out = frame(spark, sf_dir, ANSWERS_SQL)
    evidence = F.array(F.struct(F.col("source").alias("title"), F.col("gold_answer").alias("excerpt")))
    return out.withColumns({
        "required_conditions": F.when(F.col("case_id") % 3 == 0, F.array(F.lit("the"), F.lit("tion"), "gold_answer")), "forbidden_claims": F.when(F.col("case_id") % 6 == 1, F.array(F.lit("zz top"), "source")),
        "gold_evidence": F.when(F.col("case_id") % 2 == 0, evidence), "expected_format": F.when(F.col("case_id") % 10 == 0, "json_object"), "json_keys": F.when(F.col("case_id") % 10 == 0, F.array(F.lit("answer"))),
        "json_only": F.lit(False), "fenceless": F.lit(False),
    })
