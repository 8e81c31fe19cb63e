"""Queries of the views and of disclosure checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeflow.operators import disclosure, judges, tables, views
from gradeflow.plans import fixtures as fx
from gradeflow.plans.queries import WS, _CASES, _CONSENSUS, _NORMAL, _s, _v, query, rounded

#: Consensus with the first judge's error type, a gate, and the change against the first model.
_ROWS = f"""{_CONSENSUS}, {_CASES}, w AS (SELECT s.config_id, s.case_id, s.acc, s.overall, s.pass, p.error_type, CASE WHEN s.agreement_status = 'review_needed' THEN 'review' WHEN s.pass THEN 'pass' WHEN k.severity = 'critical' THEN 'block' ELSE 'review' END AS release_gate, k.qa_topic, k.question_type, s.overall - b.overall AS score_delta
FROM s JOIN p ON s.config_id = p.config_id AND s.case_id = p.case_id AND p.judge_id = 'j0' JOIN k ON k.case_id = s.case_id JOIN s b ON b.case_id = s.case_id AND b.config_id = 'm0')"""
_BAD = "(NOT pass OR overall < 0.6)"


def rows(spark, d):
    s = _s(spark, d)
    first = _v(spark, d).where("judge_id = 'j0'").select("config_id", "case_id", "error_type")
    out = s.join(first, ["config_id", "case_id"]).join(fx.cases(spark, d).select("case_id", "severity", "qa_topic", "question_type"), "case_id")
    gate = F.when(F.col("agreement_status") == "review_needed", "review").when(F.col("pass"), "pass").when(F.col("severity") == "critical", "block").otherwise("review")
    base = F.max(F.when(F.col("config_id") == "m0", F.col("overall"))).over(Window.partitionBy("case_id"))
    return out.withColumn("_base", base).where("_base is not null").withColumns({"release_gate": gate, "score_delta": F.col("overall") - F.col("_base")}).select("config_id", "case_id", "acc", "overall", "pass", "error_type", "release_gate", "qa_topic", "question_type", "score_delta")


def _mode(mode: str, test: str) -> None:
    def run(spark, d):
        return views.of_mode(rows(spark, d), mode).select("config_id", "case_id", "release_gate", "error_type")

    run.__name__ = f"rows_{mode}"
    query(f"WITH {_ROWS} SELECT config_id, case_id, release_gate, error_type FROM w WHERE {test}")(run)


_mode("failures", _BAD)
_mode("passes", f"NOT {_BAD}")
_mode("safety", "release_gate = 'block' OR contains(error_type, 'unsafe') OR contains(error_type, 'policy') OR contains(error_type, 'privacy')")
_mode("review", "release_gate IN ('block', 'review')")
_mode("different", "case_id IN (SELECT case_id FROM w GROUP BY 1 HAVING count(DISTINCT pass) > 1 OR max(overall) - min(overall) >= 0.15)")


@query(f"WITH {_ROWS}, f AS (SELECT *, CASE WHEN error_type = 'normal' THEN 'partial_inaccuracy' ELSE error_type END AS type, round(overall, 6) AS o FROM w WHERE {_BAD}) SELECT type, count(*) AS n, count(DISTINCT config_id) AS models, round(avg(o), 9) AS average, arg_min(case_id, struct_pack(a := o, b := case_id, c := config_id)) AS worst_case FROM f GROUP BY 1")
def failure_distribution(spark, d):
    """A30, P35."""
    return views.failure_distribution(rounded(rows(spark, d), "overall")).withColumn("average", F.round("average", 9))


@query(f"WITH {_ROWS}, cells AS (SELECT qa_topic, coalesce(question_type, 'unknown') AS question_type, count(*) AS n, round(avg(overall), 6) AS average FROM w GROUP BY 1, 2), down AS (SELECT qa_topic, row_number() OVER (ORDER BY qa_topic = 'unknown', sum(n) DESC, qa_topic) AS qa_topic_place FROM cells GROUP BY 1), across AS (SELECT question_type, row_number() OVER (ORDER BY question_type = 'unknown', sum(n) DESC, question_type) AS question_type_place FROM cells GROUP BY 1) SELECT * FROM cells JOIN down USING (qa_topic) JOIN across USING (question_type)")
def heat_matrix(spark, d):
    """A28, A29."""
    return rounded(views.heat_matrix(rows(spark, d), "qa_topic", "question_type"), "average")


@query(f"WITH {_ROWS} SELECT release_gate, count(*) AS n, count(DISTINCT case_id) AS cases, round(avg(overall), 6) AS average, round(avg(pass::INT), 6) AS pass_rate FROM w GROUP BY 1")
def scores_by_gate(spark, d):
    """A31, A33, A35."""
    return rounded(views.by_key(rows(spark, d), "release_gate"), "average", "pass_rate")


_ARB = _NORMAL.replace(fx.VERDICTS_SQL, fx.ARBITER_SQL).replace("v AS (", "av AS (").replace("p AS (", "ap AS (").replace("FROM v)", "FROM av)")


@query(f"WITH {_NORMAL}, {_ARB}, x AS (SELECT config_id, judge_id, overall, pass FROM p UNION ALL SELECT config_id, 'arbiter', overall, pass FROM ap) SELECT config_id, judge_id, count(*) AS n, round(avg(overall), 6) AS average, round(avg(pass::INT), 6) AS pass_rate FROM x GROUP BY 1, 2")
def judge_buckets(spark, d):
    """A32."""
    return rounded(views.judge_buckets(_v(spark, d), judges.normalised(fx.arbiter(spark, d))), "average", "pass_rate")


_MODELS = "m AS (SELECT config_id, count(*) AS n, avg(overall) AS average, avg(pass::INT) AS pass_rate FROM s GROUP BY 1)"


@query(f"WITH {_CONSENSUS}, {_MODELS} SELECT a.config_id AS left_config_id, b.config_id AS right_config_id, round(a.average - b.average, 6) AS score_delta, round(a.pass_rate - b.pass_rate, 6) AS pass_rate_delta, CASE WHEN abs(a.average - b.average) < 0.05 THEN 'tie' WHEN a.average > b.average THEN a.config_id ELSE b.config_id END AS winner FROM m a, m b WHERE a.config_id = 'm1' AND b.config_id = 'm4'")
def head_to_head(spark, d):
    """A34."""
    return rounded(views.head_to_head(views.by_key(_s(spark, d), "config_id"), "m1", "m4"), "score_delta", "pass_rate_delta")


@query(f"WITH {_ROWS}, m AS (SELECT config_id, count(*) AS n, avg(overall) AS average, avg(pass::INT) AS pass_rate, CASE WHEN bool_or(release_gate = 'block') THEN 'block' WHEN bool_or(release_gate = 'review') THEN 'review' ELSE 'pass' END AS g FROM w GROUP BY 1) SELECT count(*) AS models, max(n) AS total, round(avg(average), 6) AS average, round(avg(pass_rate), 6) AS pass_rate, arg_min(g, CASE g WHEN 'block' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) AS worst_gate FROM m")
def models_overview(spark, d):
    """A26, A27, K7."""
    r = rows(spark, d)
    gate = F.min_by("release_gate", F.struct(views.gate_rank(F.col("release_gate")), "release_gate"))
    per = r.groupBy("config_id").agg(F.count("*").alias("n"), F.avg("overall").alias("average"), F.avg(F.col("pass").cast("int")).alias("pass_rate"), gate.alias("release_gate"))
    return rounded(views.overview(per), "average", "pass_rate")


_WATCH = f"({_BAD} OR score_delta < 0 OR acc < 0.6 OR release_gate IN ('block', 'review'))"


@query(f"WITH {_ROWS} SELECT config_id, case_id, release_gate, round(score_delta, 6) AS score_delta FROM w WHERE {_WATCH}")
def regression_watch_list(spark, d):
    """K8."""
    return rounded(views.watch_list(rows(spark, d)).select("config_id", "case_id", "release_gate", "score_delta"), "score_delta")


@query(f"WITH {_ROWS} SELECT count(*) FILTER (WHERE {_WATCH}) AS watched, count(*) FILTER (WHERE score_delta < 0) AS fallen, count(*) FILTER (WHERE {_BAD}) AS failed, round(least(min(score_delta), 0), 6) AS worst_fall FROM w")
def regression_kpis(spark, d):
    """A36."""
    return rounded(views.regression_kpis(rows(spark, d)), "worst_fall")


@query(f"WITH {_ROWS} SELECT config_id, case_id, round(overall, 6) AS overall FROM w WHERE {_BAD} ORDER BY round(overall, 6), config_id, case_id LIMIT 40 OFFSET 40")
def failures_second_page(spark, d):
    """K2, K6: what follows the last key of the first page."""
    all_ = rounded(rows(spark, d), "overall")
    return views.worst_first(all_, views.last_key(views.worst_first(all_), views.BY_SCORE)).select("config_id", "case_id", "overall")


@query(f"WITH {_CASES}, r AS (SELECT case_id, coalesce(question_type, 'unknown') AS t, row_number() OVER (PARTITION BY coalesce(question_type, 'unknown') ORDER BY case_id) AS n, min(case_id) OVER (PARTITION BY coalesce(question_type, 'unknown')) AS f FROM k) SELECT case_id FROM r ORDER BY n, f LIMIT 50")
def case_preview(spark, d):
    """W13, K9."""
    return views.preview(fx.cases(spark, d), 50).select("case_id")


@query(f"WITH {_NORMAL} SELECT judge_id, count(*) AS rows, count(overall) AS usable, count(DISTINCT config_id) AS models FROM p GROUP BY 1")
def verdict_inventory(spark, d):
    """A25, F7."""
    return views.inventory(_v(spark, d))


@query(f"WITH {_ROWS} SELECT config_id, case_id, round(score_delta, 6) AS score_delta FROM w WHERE score_delta < 0 AND config_id <> 'm0'")
def fallen_cases(spark, d):
    """J1 over the widened rows."""
    out = tables.regressions(_s(spark, d), "m0").where("score_delta < 0")
    return rounded(out.select("config_id", "case_id", "score_delta"), "score_delta")


def _kind(name: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN '{name}' END"


_DIGIT_RUNS = "regexp_extract_all(t, '\\b(?:\\d[ -]?){13,19}\\b')"
_LUHN = "list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 1 THEN (x[i]::INT * 2) // 10 + (x[i]::INT * 2) % 10 ELSE x[i]::INT END)) % 10 = 0"
_TOLD = " OR ".join(f"contains(t, '{w}')" for w in disclosure.SENSITIVE)


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT *, {_TOLD} AS told, [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN {_DIGIT_RUNS}] AS runs FROM t)
SELECT doc_id, array_to_string(list_filter([CASE WHEN len(runs) > 0 AND (told OR len(list_filter(runs, lambda x: {_LUHN})) > 0) THEN 'card_number_pattern' END,
  {_kind("cvc_value_pattern", "(?i)\\bCVC\\b\\s*(?:[:：=]|는|은)?\\s*\\d{3,4}\\b")}, {_kind("password_value_pattern", "(?i)(비밀번호|패스워드|password)\\s*(?:[:：=]|는|은)?\\s*\\d{4,}")}, {_kind("resident_id_pattern", "\\b\\d{6}[- ]?\\d{7}\\b")}], lambda x: x IS NOT NULL), ',') AS kinds FROM r""")
def text_disclosures(spark, d):
    """Kinds of sensitive values in each whole text."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.array_join(disclosure.disclosures(F.col("text")), ",").alias("kinds"))


def _dealt_texts(spark, d):
    """Documents with text and source; the work is in the texts, so rows are dealt to all tasks, however few files or row groups hold them."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").repartition(spark.sparkContext.defaultParallelism)


_DENIED = " OR ".join(f"contains(n, '{x}')" for x in disclosure.DENIALS)


@query(f"""WITH c AS (SELECT DISTINCT doc_id, text, trim(c) AS c, k FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(['the', ' tion ', source]) AS c, unnest([1, 2, 3]) AS k FROM documents) WHERE trim(c) <> ''),
w AS (SELECT *, instr(text, c) AS pos, contains(lower(regexp_replace(text, '{WS}', '', 'g')), lower(regexp_replace(c, '{WS}', '', 'g'))) AS loose FROM c),
n AS (SELECT *, CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 40), pos + length(c) + 60 - greatest(1, pos - 40)) ELSE text END AS n FROM w),
h AS (SELECT doc_id, c, min(k) AS k FROM n WHERE (pos > 0 OR loose) AND NOT ({_DENIED}) GROUP BY ALL)
SELECT d.doc_id, coalesce((SELECT string_agg(c, ',' ORDER BY k) FROM h WHERE h.doc_id = d.doc_id), '') AS hits FROM documents d""")
def forbidden_claims(spark, d):
    """T10, over every text; claims that are not sensitive."""
    claims = F.array(F.lit("the"), F.lit(" tion "), F.col("source"))
    return _dealt_texts(spark, d).select("doc_id", F.array_join(disclosure.forbidden_hits(F.col("text"), claims), ",").alias("hits"))


@query()
def forbidden_claims_all(spark, d):
    """T10 with a sensitive claim, whose kinds of disclosure follow."""
    claims = F.array(F.lit("the"), F.lit(" tion "), F.lit("카드번호"), F.col("source"))
    return _dealt_texts(spark, d).select("doc_id", F.array_join(disclosure.forbidden_hits(F.col("text"), claims), ",").alias("hits"))


_SAFE = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"
for _pattern, _instead in disclosure.CODE:
    _SAFE = f"regexp_replace({_SAFE}, '{_pattern}', '{_instead}', 'g')"
for _term, _instead in disclosure.REDACTED.items():
    _SAFE = f"replace({_SAFE}, '{_term}', '{_instead}')"
for _pattern, _instead in disclosure.LINKS:
    _SAFE = f"regexp_replace({_SAFE}, '{_pattern}', '{_instead}', 'g')"


@query(f"SELECT doc_id, CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || '...' ELSE t END AS text FROM (SELECT doc_id, {_SAFE} AS t FROM documents) AS s")
def texts_redacted(spark, d):
    """P43."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", disclosure.redacted(F.col("text")).alias("text"))


@query(f"WITH {_CASES} SELECT case_id FROM k WHERE qa_topic IN ('short', 'long') AND question_type IS NOT NULL AND question_type <> 'unknown'")
def faceted_cases(spark, d):
    """F4."""
    return views.faceted(fx.cases(spark, d), {"qa_topic": ["short", "long"], "question_type": []}).select("case_id")


@query(f"WITH {_NORMAL}, {_CASES} SELECT config_id, count(DISTINCT case_id) AS done, (SELECT count(DISTINCT case_id) FROM k) AS total, round(count(DISTINCT case_id) * 100.0 / (SELECT count(DISTINCT case_id) FROM k), 9) AS percent FROM p WHERE overall >= 0.5 GROUP BY 1")
def answers_done(spark, d):
    """A37."""
    return views.done_counts(_v(spark, d).where("overall >= 0.5"), fx.cases(spark, d)).withColumn("percent", F.round("percent", 9))


@query("SELECT o_custkey AS id, count(*) AS times, max(o_orderkey) AS kept FROM orders GROUP BY 1")
def repeated_predictions(spark, d):
    """Orders stand for predictions, customers for scenarios."""
    out = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return views.repeated_ids(out, "id", "o_orderkey")
