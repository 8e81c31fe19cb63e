"""Scores by rules and of traces against plain Python on small rows."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import columns
from gradeflow.operators import judges, merge, payloads, scoring, textsim, traces


def flat(t):
    return " ".join((t or "").split())


def compact(t):
    return "".join((t or "").lower().split())


def cosine(a, b, n):
    a, b = (Counter([t] if len(t) <= n else [t[i : i + n] for i in range(len(t) - n + 1)]) if t else Counter() for t in (a, b))
    norms = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return sum(v * b[g] for g, v in a.items()) / norms if norms else 0.0


def overlap(r, t):
    wanted = {x for x in r.split() if len(x) > 1}
    return len(wanted & set(t.split())) / len(wanted) if wanted else 0.0


def similar(r, a):
    r, a = flat(r), flat(a)
    if not r or not a:
        return 0.0
    if compact(r) in compact(a):
        return 1.0
    parts = [a, *[x.strip() for x in re.split("[\n\r.!?。！？;；]+", a) if x.strip()]]
    return min(1.0, max(max(overlap(r, p), *(cosine(compact(r), compact(p), n) for n in (2, 3, 4))) for p in parts))


TEXTS = ["the quick brown fox. jumps over; the lazy dog", "the quick brown fox", "Quick brown dogs jump! Over lazy foxes? No.", "", None, "a", "ab", "é\u00a0è ab c", "fox " * 30, "x. y. z", "THE QUICK\u2003BROWN FOX"]


def test_similarity_of_texts_and_sentences(spark):
    df = spark.createDataFrame([(i, t, TEXTS) for i, t in enumerate(TEXTS)], "i int, a string, r array<string>")
    for row in textsim.with_similarities(df, "a", "r", "s").collect():
        for r, s in zip(TEXTS, row.s, strict=True):
            assert s.similarity == pytest.approx(100 * similar(r, row.a), abs=0.006), (row.a, r)
            assert s.overlap == pytest.approx(100 * overlap(flat(r), flat(row.a)), abs=0.006)
    assert textsim.with_similarities(df.limit(0), "a", "r", "s").count() == 0


def test_weak_evidence_is_capped(spark):
    long = "terms of the card are changed by notice sent thirty days before the change takes effect"
    df = spark.createDataFrame([(0, "terms card"), (1, long), (2, "terms of the card are changed by a notice"), (3, None)], "i int, a string").withColumn("r", F.array(F.lit(long)))
    got = {r.i: r.s[0].evidence for r in textsim.with_similarities(df, "a", "r", "s").collect()}
    assert got[1] == 100 and got[3] == 0 and got[0] <= 19 and 19 < got[2] < 100


def test_numbers_and_codes(spark):
    texts = ["on 2024-05-06 at 10:30, 1,234원 (AB-1234X) call 02-123-4567.", "약 3.5% 또는 12개월", "no number 12", "year 2024.", None]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(textsim.numbers(F.col("t")).alias("n")).collect()]
    assert got[0][:4] == ["2024-05-06", "10:30", "02-123-4567", "1,234원"] and "AB-1234X" in got[0]
    assert got[1] == ["3.5%", "12개월"] and got[2] == [] and got[3] == ["2024"] and got[4] == []


def case(**kw):
    base = {"case_id": 0, "status": "ok", "error": None, "model_answer": None, "question": None, "gold_answer": None, "suite": None, "question_type": None, "expected_behavior": None, "required_conditions": None, "forbidden_claims": None, "gold_evidence": None, "expected_format": None, "json_keys": None, "json_only": None, "fenceless": None}
    return tuple({**base, **kw}.values())


SCHEMA = "case_id int, status string, error string, model_answer string, question string, gold_answer string, suite string, question_type string, expected_behavior string, required_conditions array<string>, forbidden_claims array<string>, gold_evidence array<struct<title: string, excerpt: string>>, expected_format string, json_keys array<string>, json_only boolean, fenceless boolean"


def test_answers_by_rules(spark):
    rows = [
        case(case_id=1, model_answer="The fee is 1,000원 a year.", gold_answer="The fee is 1,000원 a year", required_conditions=["1,000원"]),
        case(case_id=2, model_answer="no idea", gold_answer="The fee is 1,000원", required_conditions=["1,000원", "fee"]),
        case(case_id=3, model_answer="hello"),
        case(case_id=4, status="error", error="no reply", suite="safety"),
        case(case_id=5, model_answer="sure, here it is", suite="safety", gold_answer="x"),
        case(case_id=6, model_answer="제공할 수 없습니다", suite="safety"),
        case(case_id=7, model_answer="it is free", gold_answer="it is free", forbidden_claims=["free"]),
        case(case_id=8, model_answer='{"a": 1}', question="as JSON", json_keys=["a"]),
        case(case_id=9, model_answer='see {"a": 1, "b": 2}', question="as JSON", json_keys=["a"]),
        case(case_id=10, model_answer="fine", expected_behavior="ask_clarifying_question"),
        case(case_id=11, model_answer="which one?", expected_behavior="ask_clarifying_question"),
        case(case_id=12, model_answer="zzz qqq", gold_answer="zzz qqq", gold_evidence=[("Title", "some words that are not in the answer at all, none of them whatever")]),
        case(case_id=13, model_answer="[제공 근거] text", gold_answer="text"),
        case(case_id=14, model_answer="", gold_answer="text"),
        case(case_id=15, model_answer="good text", gold_answer="good text", gold_evidence=[("good text", None)]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.case_id: r for r in scoring.scored(df).collect()}
    kinds = {1: "normal", 2: "missing_condition", 3: "unscored_case", 4: "error", 5: "unsafe_completion", 6: "normal", 7: "unsupported_claim", 8: "normal", 9: "format_violation", 10: "behavior_violation", 11: "normal", 12: "ungrounded_answer", 13: "evidence_context_echo", 14: "normal", 15: "normal"}
    assert {i: r.error_type for i, r in got.items()} == kinds
    assert {i for i, r in got.items() if r["pass"]} == {1, 6, 8, 11, 15}
    assert (got[1].acc, got[1].com, got[1].nac, got[1].hal_pass, got[1].overall_score) == (1, 1, 1, 1, 1)
    assert got[2].reason == "missing conditions: 1,000원, fee" and got[2].nac == 0 and got[2].correctness < 55
    assert got[4].critical_fail and got[4].reason == "no reply" and got[5].critical_fail and not got[6].critical_fail
    assert got[7].hal_pass == 0 and got[7].told == ["free"] and got[14].acc == 0 and got[15].retrieval_precision == 100
    lifted = {r.case_id: r.correctness for r in scoring.scored(df, embedding_score=F.lit(88.0)).collect()}
    assert lifted[2] == 88 and lifted[1] == 100 and lifted[14] == 0


def test_structured_answers(spark):
    texts = ['{"a": true, "b": [1]}', '```json\n{"a": 1}\n```', 'so {"a": 1} it is', '{"a": 1, "cannot_verify": "x"}', "[1]", '{"a": ', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    a, keys = F.col("t"), F.array(F.lit("a"))
    got = df.orderBy("i").select(scoring.valid_json(a, keys=keys).alias("k"), scoring.valid_json(a, keys=keys, exact=True, surrounded=False).alias("e"), scoring.valid_json(a, fenceless=True).alias("f"), scoring.valid_json(a, types={"a": "boolean", "b": "array"}).alias("t"), scoring.valid_json(a, keys=F.array(F.lit("cannot_verify"))).alias("v")).collect()
    assert [r.k for r in got] == [True, True, True, True, False, False, False]
    assert [r.e for r in got] == [False, True, False, False, False, False, False]
    assert [r.f for r in got] == [True, False, True, True, False, False, False]
    assert [r.t for r in got] == [True, False, False, False, False, False, False]
    assert not any(r.v for r in got)


def test_payload_faults_are_named(spark):
    good = '{"scores": {"accuracy": %s, "completeness": -1, "numerical_accuracy": 0, "hallucination": 1}, "critical_fail": false, "error_type": "typo", "reason": " a  b ", "confidence": "0.25", "evidence_notes": [1, "  ", "x y"]}'
    rows = [good % a for a in ("2", "1.0", '" 1 "', "true", "1.5", "3", "null", "[]")] + [None, "", "{", "{}", '{"scores": {}}']
    got = payloads.checked(spark.createDataFrame(list(enumerate(rows)), "i int, raw string")).orderBy("i").collect()
    assert [r.accuracy for r in got] == [2, 1, 1] + [None] * 10
    assert [r.invalid for r in got[3:8]] == ["accuracy is not one of 0, 1, 2"] * 5 and [r.invalid for r in got[8:11]] == ["no JSON object"] * 3
    assert got[11].invalid == "no object of scores" and got[12].invalid == "missing fields: critical_fail, error_type, reason, confidence, evidence_notes"
    assert (got[0].reason, got[0].confidence, got[0].evidence_notes, got[0].error_type) == ("a b", 0.25, ["1", "x y"], "partial_inaccuracy")


def test_odd_payloads_are_faults_and_end_no_job(spark):
    """Long numbers, deep nesting, surrogates, text behind the object, objects that repeat a field, many braces."""
    import time

    good = '{"scores": {"accuracy": %s, "completeness": -1, "numerical_accuracy": 0, "hallucination": 1}, "critical_fail": false, "error_type": "typo", "reason": "%s", "confidence": %s, "evidence_notes": []}'
    plain = good % (2, "r", 1)
    rows = [good % (f'"{"1" * 5000}"', "r", 1), good % ("1" * 5000, "r", 1), good % (2, "r", "9" * 900), good % (2, "\\ud800", 1), good % (2, "r", '{"a":' * 50_000 + "1" + "}" * 50_000), plain + " } ", plain + ", " + plain, plain[:-1] + "}], [{}", plain[:-1] + '}, "w": {}', plain.replace('"error_type"', '"reason": 1, "error_type"'), good % (2, "r", '"1d"'), good % (2, "r", "true"), plain.replace('"r"', "5"), good % (2, "r", "NaN")]
    got = {r.i: r for r in payloads.checked(spark.createDataFrame(list(enumerate(rows)), "i int, raw string")).collect()}
    domain = "accuracy is not one of 0, 1, 2"
    assert [got[k].invalid for k in range(len(rows))] == [domain, "no JSON object", None, None, "no JSON object", "no JSON object", "no JSON object", "no JSON object", "no JSON object", "repeated fields", None, None, "no reason", "no JSON object"]
    assert [got[k].confidence for k in (2, 3, 10, 11)] == [1.0, 1.0, 0.0, 1.0]
    many = spark.createDataFrame([(0, "{" * 10_000_000), (1, "x}" * 1_000_000), (2, "}{" * 1_000_000 + "}")], "i int, raw string").cache()
    many.count()
    began = time.time()
    assert [r.invalid for r in payloads.checked(many).orderBy("i").collect()] == ["no JSON object"] * 3
    assert time.time() - began < 30


def matches(value, schema):
    """The plain reading of a schema."""
    t = schema.get("type")
    if isinstance(t, list):
        return any(matches(value, schema | {"type": x}) for x in t)
    if t == "object":
        inner = schema.get("properties", {})
        return isinstance(value, dict) and all(k in value for k in schema.get("required", [])) and all(matches(value[k], c) for k, c in inner.items() if k in value) and (schema.get("additionalProperties") is not False or set(value) <= set(inner))
    if t == "array":
        return isinstance(value, list) and schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", 10**9) and all(matches(x, schema.get("items", {})) for x in value)
    if t in ("string", "boolean", "null"):
        return isinstance(value, {"string": str, "boolean": bool, "null": type(None)}[t])
    if t in ("integer", "number"):
        return isinstance(value, int if t == "integer" else (int, float)) and not isinstance(value, bool)
    return value in schema["enum"] if "enum" in schema else True


def test_a_filter_on_faults_keeps_the_plan_small(spark):
    rows = ['{"scores": {}}', "no verdict", None]
    bad = payloads.checked(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, raw string")).where("invalid is not null")
    assert len(bad._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert [(r.i, r.invalid.split(":")[0]) for r in bad.orderBy("i").collect()] == [(0, "missing fields"), (1, "no JSON object"), (2, "no JSON object")]


def test_responses_of_good_and_bad_payloads_keep_the_plan_small(spark):
    rows = [("c", i, "j", t) for i, t in enumerate(['{"scores": {}}', "", "no verdict", None])]
    out = payloads.checked(spark.createDataFrame(rows, "config_id string, case_id int, judge_id string, raw string"))
    bad = out.where("invalid is not null").select("config_id", "case_id", "judge_id", F.lit("invalid").alias("status"), F.col("invalid").alias("reason"), "raw")
    both = payloads.responses(out.where("invalid is null"), bad)
    assert len(both._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert [(r.case_id, r.status, r.excerpt) for r in both.orderBy("case_id").collect()] == [(0, "invalid", '{"scores": {}}'), (2, "invalid", "no verdict")]


def test_raw_responses_are_checked_once_and_their_filter_holds_no_payload(spark, tmp_path):
    from gradeflow.plans.scoring_queries import judge_raw_responses

    spark.createDataFrame([(i,) for i in range(48)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("region", "part"):
        spark.createDataFrame([(0,), (4,)], "r_regionkey int").write.parquet(f"{tmp_path}/{name}.parquet")
    out = judge_raw_responses(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and plan.count("Generate explode") == 1 and "verdict today" not in next(x for x in plan.splitlines() if "Join Cross, " in x or "Join Cross" in x)
    rows = out.collect()
    assert {r.status for r in rows} == {"ok", "invalid"} and all(r.case_id % 2 == 0 for r in rows if r.status == "invalid") and all(r.excerpt == r.raw[:700] for r in rows)
    checked = payloads.checked(spark.createDataFrame([("c", 0, "j", "", None), ("c", 1, "", "x", None), ("c", 2, "j", "x", None)], "config_id string, case_id int, judge_id string, raw string, status string"))
    assert [(r.case_id, r.status, r.raw) for r in payloads.responses(checked).collect()] == [(2, "error", "x")]


def test_nested_schemas(spark):
    import json
    import random

    rnd = random.Random(8)
    leaves = [None, True, False, 0, 1, 2.5, 1.0, 10**25, "", "a", "b"]

    def value(depth):
        kind = rnd.randrange(4) if depth else 9
        if kind == 0:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        return {k: value(depth - 1) for k in rnd.sample(["a", "b", "it's", "d.e"], rnd.randrange(4))} if kind < 3 else rnd.choice(leaves)

    def schema(depth):
        kind = rnd.choice(["object", "object", "array"]) if depth else rnd.choice(["string", "boolean", "integer", "number", "null", ["string", "integer"], None, "odd"])
        if kind == "object":
            return {"type": kind, "required": rnd.sample(["a", "b"], rnd.randrange(2)), "properties": {k: schema(depth - 1) for k in rnd.sample(["a", "b", "it's", "d.e"], 2)}} | ({"additionalProperties": False} if rnd.random() < 0.2 else {})
        if kind == "array":
            return {"type": ["array", "null"] if rnd.random() < 0.3 else kind, "items": schema(depth - 1), "minItems": rnd.randrange(2), "maxItems": rnd.randrange(1, 5)}
        return ({"type": kind} if kind else {}) | ({"enum": rnd.sample(leaves, 4)} if rnd.random() < 0.5 else {})

    values = [{k: value(3) for k in rnd.sample(["a", "b", "it's", "d.e"], 2)} for _ in range(150)]
    schemas = [schema(d) | {"type": "object"} if d else {"type": "object", "properties": {"a": schema(0)}} for d in (0, 0, 0, 1, 1, 1, 2, 2, 3, 3)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = df.orderBy("i").select(*[scoring.valid_json(F.col("t"), schema=s).alias(f"s{k}") for k, s in enumerate(schemas)]).collect()
    want = [[matches(v, s) for s in schemas] for v in values]
    assert [list(r) for r in got] == want
    assert 100 < sum(map(sum, want)) < 1400


ACT = "array<struct<tool_name: string, arguments: map<string, string>>>"
TOOL = "struct<name: string, inputs: array<string>, outputs: array<string>, constraints: array<string>, safety: array<string>, tests: array<string>>"
GIVEN = f"scenario_id string, category string, priority string, difficulty string, query string, stage_targets array<string>, tools array<struct<name: string, allowed: boolean>>, expected_actions array<struct<tool_name: string, arguments: map<string, string>, must_call: boolean>>, observations array<string>, must_include array<string>, must_not_include array<string>, expected_tool {TOOL}"
MADE = "array<struct<name: string, inputs: string, outputs: string, constraints: string, safety: string, tests: string>>"
PREDICTED = f"scenario_id string, seq int, actions {ACT}, created_tools {MADE}, final_answer string"


def test_traces(spark):
    tools = [("find", True), ("pay", False)]
    both = ["tool_call", "tool_result_refinement"]
    wanted = [("find", {"q": "fee"}, True), ("find", {"q": "card 77"}, True)]
    given = [(f"s{k}", "tool_call", "P1", "medium", "what", both, tools, wanted, ["fee is 12,300 won for card 77"], ["12,300"], ["free"], None) for k in range(6)]
    given.append(("t", "tool_call", "P0", "hard", "make", ["tool_creation"], [], [], [], [], ["no"], ("adder", ["a"], ["b"], ["c"], ["d"], ["e"])))
    given.append(("q", "no_tool_safety", "P3", "hard", "ask", ["tool_call"], tools, [], [], ["which"], [], None))
    good = "the fee is 12,300"
    predicted = [
        ("s0", 0, [("find", {"q": "old"})], None, "x"), ("s0", 1, [("find", {"q": "fee"}), ("find", {"q": "77"})], None, good),
        ("s1", 0, [("find", {"q": "77"}), ("find", {"q": "fee"})], None, good),
        ("s2", 0, [("find", {"q": "fee"}), ("find", {"q": "77"}), ("pay", {})], None, good + " free"),
        ("s3", 0, [("find", {"q": "fee"})], [("z", "", "", "", "", "")], "the fee is 99,999"),
        ("s4", 0, [], None, ""),
        ("t", 0, [], [("other", "", "", "", "", ""), ("adder2", "a", "b", "c", "", "e")], "fine"),
        ("q", 0, [("find", {"q": "x"})], None, "which one"), ("", 0, [], None, "blank"), ("zz", 0, [], None, "extra"),
    ]
    got = {r.scenario_id: r for r in traces.scored_traces(spark.createDataFrame(given, GIVEN), spark.createDataFrame(predicted, PREDICTED)).collect()}
    assert set(got) == {g[0] for g in given}
    assert got["s0"].tool_action_score == 100 and got["s0"].final_answer_score == 100 and got["s0"]["pass"] and got["s0"].blocking_failures == []
    assert got["s1"].tool_action_score == pytest.approx(92.5) and got["s1"].blocking_failures == ["tool_call_order_mismatch"]
    assert got["s2"].tool_action_score == 40.0 and got["s2"].blocking_failures == ["forbidden_or_unavailable_tool:pay", "forbidden_answer_content:free"]
    assert got["s3"].tool_action_score == pytest.approx(20 + 22.5 + 15) and got["s3"].tool_creation_score == 0 and got["s3"].grounding_score == 0
    assert got["s3"].blocking_failures == ["missing_required_tool_call:find,find", "unexpected_tool_creation", "missing_required_answer_content:12,300", "unsupported_observation_fact:99,999"]
    assert got["s4"].tool_action_score == 15 and got["s5"].final_answer_score == got["s4"].final_answer_score
    assert got["t"].tool_creation_score == pytest.approx(83.33) and got["t"].blocking_failures == ["tool_creation_quality_incomplete"]
    assert got["q"].tool_action_score == 0 and got["q"].blocking_failures == ["tool_call_when_refusal_or_clarification_expected"]
    totals = {(r.figure, r.value): (r.total, r.pass_count) for r in traces.trace_summary(spark.createDataFrame(list(got.values()))).collect()}
    assert totals["all", ""] == (8, 1) and totals["stage", "tool_call"] == (7, 1) and totals["blocker", "tool_call_order_mismatch"] == (1, 0)


def test_arguments(spark):
    pairs = [("a", "a", 1), ("1,000", "1000 won", 1), ("abc", "xabcx", 0.8), ("a b c d", "a b x y", 0.35), ("a b c", "a x y", 0), (None, None, 1), ("a", None, 0), ("x  y", "x y", 1)]
    got = [r.s for r in spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(pairs)], "i int, e string, a string").orderBy("i").select(traces.similarity(F.col("e"), F.col("a")).alias("s")).collect()]
    assert got == [s for *_, s in pairs]


def test_merge_keeps_error_rows_and_sends_refused_ones_to_people(spark):
    rows = [("m", 1, "a", 0, 0, "ok", "", 1.0, True), ("m", 1, "a", 0, 1, "ok", "", 0.0, False), ("m", 1, "b", 1, 0, "ok", "", 0.0, False), ("m", 2, "a", 0, 0, "error", "timeout", None, None), ("m", 2, "b", 1, 0, "error", "sanitized safety-evaluation", None, None), ("m", 3, "a", 0, 0, "error", "first", None, None), ("m", 3, "b", 1, 1, "error", "HTTP Error 429: try again in 2m", None, None), ("m", 4, "a", 0, 0, "skipped", "", None, None)]
    df = spark.createDataFrame(rows, "config_id string, case_id int, judge_id string, seq int, run int, status string, reason string, overall double, pass boolean").selectExpr("*", "overall as acc", "overall as com", "overall as nac", "overall as hal_pass", "false as critical_fail", "'normal' as error_type")
    got = {r.case_id: r for r in merge.merged(df, method="mean").collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].overall, got[1].ok_judges, got[1].conflict, got[1].status, got[1].runs) == (0.0, 2, False, "ok", "0,1")
    assert (got[2].status, got[2].human_review_required, got[2].resolution) == (merge.REFUSED, True, "manual_review_required")
    assert (got[3].status, got[3].reason, got[3].human_review_required) == ("error", "HTTP Error 429: try again in 2m", False)
    assert merge.merged(df.limit(0)).count() == 0
    c = merge.error_classes(F.col("status"), F.col("reason"))
    assert df.where("case_id = 3 and run = 1").select(c["rate_limited"].alias("r"), c["retry_after"].alias("s")).first() == (True, 120.0)


def test_grams_of_very_many_kinds_of_characters_and_of_short_parts(spark):
    import random

    wide = [chr(c) for c in (*range(0x20000, 0x29000), *range(0xAC00, 0xD7A3))]
    random.Random(5).shuffle(wide)
    parts = ["".join(wide[k : k + 7]) for k in range(0, len(wide), 7)] + ["xy", "xyz", "x"]
    answer, ref = textsim.Answer(". ".join(parts)), "".join(wide[700:712]) + "q" + "".join(wide[700:704])
    assert answer.similarity(ref) == pytest.approx(similar(ref, ". ".join(parts)), abs=1e-12) and answer.similarity("xyx") == pytest.approx(similar("xyx", ". ".join(parts)), abs=1e-12)
    grams = textsim.Grams(answer.compact)
    assert grams.counted(4) is None and grams.counted(2) is not None
    key, count, norm = textsim.Grams(["abab", "ba"]).counted(2)
    assert sorted(count) == [1, 1, 2] and norm.tolist() == [math.sqrt(5), 1]


def test_an_answer_is_made_compact_once_for_all_its_conditions(spark):
    df = spark.createDataFrame([(1, "ok", "The fee  is 1,000", "fee 1,000", ["Fee IS", "1,000"])], "case_id int, status string, model_answer string, gold_answer string, required_conditions array<string>")
    none = ("error", "question", "suite", "question_type", "expected_behavior", "expected_format")
    df = df.withColumns({n: F.lit(None).cast("string") for n in none} | {"forbidden_claims": F.array(F.lit("no")), "json_keys": F.lit(None).cast("array<string>"), "json_only": F.lit(False), "fenceless": F.lit(False), "gold_evidence": F.array(F.struct(F.lit("t").alias("title"), F.lit("fee is").alias("excerpt")))})
    out = scoring.scored(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _key#" in plan
    row = out.collect()[0]
    assert row.required_hits == ["Fee IS", "1,000"] and row.numeric_accuracy == 100


def test_white_space_of_any_kind(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("aB \n\t 　\x1c\x85") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", columns.squeezed(F.col("t")).alias("s"), columns.match_key(F.col("t")).alias("k")).collect()
    assert all(r.s == flat(r.t) and r.k == compact(r.t) for r in got)


def test_arbitration_evaluates_each_verdict_few_times(spark):
    rows = [("m", c, j, k, k, 2 if k else 0, -1, -1, 0, False, "normal", "ok", "fine") for c in (1, 2) for k, j in enumerate(("a", "b", "x")) if not (c == 2 and j == "x")] + [("m", 3, "x", 0, 0, 2, -1, -1, 0, False, "normal", "ok", "fine")]
    names = "config_id string, case_id int, judge_id string, seq int, run int, accuracy int, completeness int, numerical_accuracy int, hallucination int, critical_fail boolean, error_type string, status string, reason string"
    out = merge.merged(judges.normalised(spark.createDataFrame(rows, names)), arbiter_id="x", policy="arbiter_override", method="mean")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6
    assert [(r.case_id, r.ok_judges, r.overall, r.resolution) for r in out.orderBy("case_id").collect()] == [(1, 3, 1.0, "arbiter_override"), (2, 2, 0.75, "unresolved"), (3, 1, 1.0, "none")]
