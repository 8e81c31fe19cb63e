"""Every query with SQL against DuckDB on the smallest tables; properties of the operators."""

import glob
import hashlib
import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeflow.functions import columns as C
from gradeflow.operators import apply, cases, compose, disclosure, facts, judges, textsim, views
from gradeflow.plans import all as queries
from gradeflow.plans import fixtures
from gradeflow.sources import files
from gradeflow.streaming import progress

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_arbiter_settles_only_conflicts_it_has_seen(spark):
    v = judges.normalised(fixtures.verdicts(spark, SF))
    arb = judges.normalised(fixtures.arbiter(spark, SF))
    for policy in ("three_judge", "arbiter_override"):
        rows = judges.resolved(v, arb, policy).collect()
        assert {(r.conflict, r.resolution) for r in rows} <= {(False, "none"), (True, policy), (True, "unresolved")}
        assert all((r.resolution == policy) == (r.conflict and r.case_id % 2 == 0) for r in rows)


def test_blank_texts_and_percent_parse(spark):
    df = spark.createDataFrame([(" Yes ", "85", "incorrect"), ("off", "0.4", ""), ("maybe", "x", "what?"), (None, None, None), ("1", "NaN", "unsafe_completion")], "b string, s string, e string")
    got = df.select(C.parse_bool(F.col("b")).alias("b"), C.score01(F.col("s")).alias("s"), C.error_type(F.col("e")).alias("e")).collect()
    assert [r.b for r in got] == [True, False, None, None, True]
    assert [r.s for r in got] == [0.85, 0.4, None, None, None]
    assert [r.e for r in got] == ["partial_inaccuracy", "normal", "partial_inaccuracy", "normal", "unsafe_completion"]


def test_quotas_by_largest_remainder(spark):
    pools = spark.createDataFrame([("a", 5.0, 0), ("b", 3.0, 1), ("c", 2.0, 2), ("d", 0.01, 3)], "pool_id string, weight double, position int")
    assert {r.pool_id: r.quota for r in compose.allotted(pools, 11).collect()} == {"a": 6, "b": 3, "c": 2}


def test_sampling_ignores_row_order_and_checks_quotas(spark):
    cases = spark.createDataFrame([(f"c{i}", "p" if i % 2 else "q") for i in range(40)], "case_id string, pool_id string")
    one = {r.case_id for r in compose.sampled(cases, {"p": 5, "q": 3}, "s").collect()}
    two = {r.case_id for r in compose.sampled(cases.orderBy(F.desc("case_id")), {"p": 5, "q": 3}, "s").collect()}
    assert one == two and len(one) == 8
    with pytest.raises(ValueError):
        compose.sampled(cases, {"p": 500}, "s")


def test_a_thousand_pools_that_share_cases_as_taken_in_turn(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", f"c{rng.randrange(2500)}", i, rng.choice(["active", "active", "shadow"]), True) for i, p in enumerate(rng.choices(range(1000), k=9000))]
    rows += [("p0", None, -1, "active", True), ("p998", "c1", None, "shadow", None)]
    pools = [compose.Pool(f"p{p}", rng.randrange(4)) for p in range(1000)] + [compose.Pool("p3", 2)]
    first = {}
    for p, c, o, status, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2])):
        if c is not None:
            first.setdefault((p, c), status)
    taken, want = set(), []
    for pool in pools:
        own = [(c, s) for (p, c), s in first.items() if p == pool.pool_id]
        kind = "active" if any(s == "active" for _, s in own) else "shadow"
        left = sorted((hashlib.sha256(f"s:{pool.pool_id}:{c}".encode()).hexdigest(), c) for c, s in own if s == kind and c not in taken)
        taken |= {c for _, c in left[: pool.quota]}
        want += [(pool.pool_id, c) for _, c in left[: pool.quota]]
    cases = spark.createDataFrame(rows, "pool_id string, case_id string, ordinal int, case_status string, gold_verified boolean")
    got = compose.composed(cases, pools, seed="s", strict=False)
    assert sorted((r.dataset_pool_id, r.case_id) for r in got.select("dataset_pool_id", "case_id").collect()) == sorted(want)
    assert compose.composed(cases.limit(0), pools, seed="s", strict=False).count() == 0


def test_pages_by_key_are_the_slices_of_the_whole_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 0.1, 0.2, 0.2, 0.7]), rng.choice([True, False, None]), f"m{rng.randrange(3)}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "overall double, flag boolean, config_id string, case_id int").repartition(5)
    order = (("flag", True), *views.BY_SCORE)
    want = sorted(rows, key=lambda r: ({True: 0, False: 1, None: 2}[r[1]], r[0] is None, r[0] or 0, r[2], r[3]))
    after, got = None, []
    while page := (df_page := views.page_after(df, order, after, 60)).collect():
        got += [tuple(r) for r in page]
        after = views.last_key(df_page, order)
    assert got == want and views.last_key(df.limit(0), order) is None
    plan = views.page_after(df, order, after, 60)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Sort" not in plan.replace("SortOrder", "")


def _nested(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    word = "".join(rng.choice('ab"\\:{}[],é漢 \n1') for _ in range(rng.randrange(6)))
    if kind < 6:
        return [word, rng.randrange(-50, 50), True, False, None, 0.25][kind]
    if kind == 6:
        return [_nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {f"{k}{word}": _nested(rng, depth - 1) for k in rng.sample("zyxwv", rng.randrange(5))}


def test_nested_json_in_canonical_form_and_as_text(spark):
    def leaves(v):
        if isinstance(v, dict | list):
            return [x for w in (v.values() if isinstance(v, dict) else v) for x in leaves(w)]
        return [str(v)] if v else []

    def shuffled(v):
        if isinstance(v, dict):
            return {k: shuffled(v[k]) for k in rng.sample(sorted(v), len(v))}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    rng = random.Random(8)
    values = [{"top": _nested(rng, 6), "a": _nested(rng, 6)} for _ in range(300)] + [[["x" * 100_000, {"k": '\\"' * 20_000}]], "plain", 7, {}]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None), json.dumps(shuffled(v))) for i, v in enumerate(values)] + [(9000, None, "[1"), (9001, "", "{} {")]
    df = spark.createDataFrame(rows, "id int, one string, two string")
    got = {r.id: r for r in df.select("id", C.canonical_json(F.col("one")).alias("c"), C.json_fingerprint(F.col("one")).alias("f"), C.json_fingerprint(F.col("two")).alias("g"), C.json_leaves(F.col("one")).alias("l"), C.json_as_text(F.col("one")).alias("t")).collect()}
    for i, v in enumerate(values):
        assert got[i].c == json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert got[i].f == got[i].g and got[i].l == leaves(v) and got[i].t == " ".join(" ".join(leaves(v)).split())
    assert {(got[i].c, got[i].f, got[i].l) for i in (9000, 9001)} == {(None, None, None)}


def test_gram_cosine_of_equal_disjoint_and_short_texts(spark):
    df = spark.createDataFrame([(1, "hello world", "hello world"), (2, "aaaa", "bbbb"), (3, "ab", "ab"), (4, "", "abc")], "key int, reference string, answer string")
    got = {r.key: round(r.cosine, 9) for r in df.select("key", textsim.gram_cosine(F.col("reference"), F.col("answer")).alias("cosine")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}


def test_question_csv_with_aliases_and_odd_rows(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿ID,Query,Ground_Truth\nx1,"a\nb",c\n,,\n,q2,\n', encoding="utf-8")
    got = files.read_cases(spark, str(tmp_path / "q.csv"), "pool").collect()
    assert [(r.case_id, r.question, r.gold_answer) for r in got] == [("x1", "a\nb", "c"), ("pool-00003", "q2", None)]


def test_lenient_and_strict_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert [r.a for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", strict=False).collect()] == [1, 2]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()


def test_streamed_consensus_equals_batch(spark, tmp_path):
    v = judges.normalised(fixtures.verdicts(spark, SF)).withColumn("ts", F.timestamp_seconds(F.col("case_id") + 1_700_000_000))
    v.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    progress.incremental(stream, f"{tmp_path}/out", f"{tmp_path}/cp", judges.consensus).awaitTermination(120)
    last = spark.read.parquet(f"{tmp_path}/out/consensus").groupBy("config_id", "case_id").agg(F.max_by("overall", "batch").alias("overall"))
    want = judges.consensus(v).select("config_id", "case_id", "overall")
    assert last.count() == want.count() and last.join(want.withColumnRenamed("overall", "w"), ["config_id", "case_id"]).where("abs(overall - w) > 1e-9").count() == 0
    done = progress.progress(spark.readStream.schema(v.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("done").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert {r.config_id: r.done for r in spark.table("done").collect()} == {r.config_id: r["count"] for r in want.groupBy("config_id").count().collect()}


def test_disclosures_and_redaction(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",), ("카드번호 4111 1111 1111 1112",), ("CVC: 123",), ("Password 12345",), ("900101-1234567",), ("plain",), ("",), (None,)], "t string")
    got = [r.k for r in df.select(disclosure.disclosures(F.col("t")).alias("k")).collect()]
    assert got == [["card_number_pattern"], [], ["card_number_pattern"], ["cvc_value_pattern"], ["password_value_pattern"], ["card_number_pattern", "resident_id_pattern"] if luhn("9001011234567") else ["resident_id_pattern"], [], [], []]
    texts = ["see https://a.b/c\n```x =\n 1```\n해킹 " + "A" * 30, "look at\n  import os\nthis", " import os\nthis", "x" * 1300, "", None]
    shown = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(disclosure.redacted(F.col("t")).alias("t")).collect()]
    assert shown[0] == "see [url omitted] [code block omitted for safety evaluation] [불법 접근] [token-like text omitted]"
    assert shown[1:] == ["look at import os this", "[code-like line omitted for safety evaluation]", "[token-like text omitted]", "", None]


def test_redaction_knows_ascii_edges_and_every_white_space(spark):
    run = "A" * 24
    texts = ["class\u00e9 x", "class_y", "cla\u017fs x", f"\u00e9{run}= x", f"{run}=\u00e9", f"x {run}\u00e9 y", "\x1cvar x", "http://a\x1cb\x1fc", f"_{run} x"]
    shown = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(disclosure.redacted(F.col("t")).alias("t")).collect()]
    code, token = "[code-like line omitted for safety evaluation]", "[token-like text omitted]"
    assert shown == [code, "class_y", code, f"\u00e9{token}= x", f"{token}=\u00e9", f"x {token}\u00e9 y", code, "[url omitted] b c", f"_{run} x"]


def test_responses_are_parsed_once_whatever_their_place(spark):
    from gradeflow.operators import requests

    raws = ['{"output_text": "a", "content": "b"}', '{"answer": "", "content": {"text": "", "message": "m"}}', '{"own": {"deep": 7}, "output_text": "a"}', '{"output": {"answer": true}}', '{"content": [1]}', "{no JSON", "", None]
    out = spark.createDataFrame([(r,) for r in raws], "raw string").select(requests.response_text(F.col("raw"), "own.deep").alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("arse") == 1
    assert [r.t for r in out.collect()] == ["a", "m", "7", "true", '{"content": [1]}', "{no JSON", "", None]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_forbidden_claims_unless_denied(spark):
    df = spark.createDataFrame([("fee is free", ["is free", "", "no"]), ("fee is free 불가", ["is free"]), ("fee isfree", ["IS FREE"]), (None, ["a"]), ("a", None)], "t string, c array<string>")
    assert [r.h for r in df.select(disclosure.forbidden_hits(F.col("t"), F.col("c")).alias("h")).collect()] == [["is free"], [], ["IS FREE"], [], []]


def test_blending_by_nothing_keeps_the_score(spark):
    v = judges.normalised(fixtures.verdicts(spark, SF))
    both = apply.attached(v.where("judge_id = 'j0'"), v.where("judge_id = 'j1'"))
    assert apply.applied(both, "blend", 0.0).where("abs(overall - static_overall) > 1e-12 or abs(acc - static_acc) > 1e-12").count() == 0
    assert apply.applied(both, "blend", 7.0).where("abs(overall - judge_overall) > 1e-12").count() == 0
    with pytest.raises(ValueError):
        apply.applied(both, "none")


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "case_id long, pool_id string, metadata map<string,string>, question_type string, tool_calls int")
    assert cases.with_behaviour(cases.with_lifecycle(none)).count() == 0 and cases.with_status(cases.with_lifecycle(none)).count() == 0
    outputs = spark.createDataFrame([], "config_id string, case_id long, status string, model_answer string")
    assert facts.complete_only(outputs, none).count() == 0


def test_log_progress_takes_the_furthest_mark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("MODEL_START 1/2 m0\nANSWER_DONE [m0] 3/9 c3\nANSWER_DONE [m0] 2/9 c2\nJUDGE_DONE [m1] 1/9 c1\nnoise [m0] 8/9\n")
    stream = progress.log_progress(spark.readStream.text(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("marks").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.config_id, r.event, r.done, r.total) for r in spark.table("marks").collect()} == {("m0", "ANSWER_DONE", 3, 9), ("m1", "JUDGE_DONE", 1, 9)}


def test_batches_touch_the_state_of_their_answers_only(spark, tmp_path):
    v = judges.normalised(fixtures.verdicts(spark, SF)).where("case_id < 40").cache()
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rocks)
    touched = []

    def run(df):
        df.write.mode("append").parquet(f"{tmp_path}/in")
        query = progress.incremental(spark.readStream.schema(v.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", judges.consensus, order="seq")
        query.awaitTermination(120)
        state = query.lastProgress["stateOperators"][0]
        touched.append((state["numRowsUpdated"], state["numRowsTotal"]))

    try:
        late = v.where("case_id = 3").orderBy("config_id", "judge_id").limit(1).cache()
        run(v.join(late, ["config_id", "case_id", "judge_id"], "left_anti").select(v.columns))
        run(late)  # late
        run(late)  # repeated
        run(late.withColumns({"seq": F.col("seq") + 1, "overall": F.lit(0.0), "acc": F.lit(0.0)}))  # said anew
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    answers = v.select("config_id", "case_id").distinct().count()
    assert [t for t, _ in touched[1:]] == [1, 1, 1] and touched[-1][1] == answers
    anew = v.join(late.select("config_id", "case_id", "judge_id", F.lit(True).alias("_new")), ["config_id", "case_id", "judge_id"], "left")
    anew = anew.withColumns({c: F.when(F.col("_new"), 0.0).otherwise(F.col(c)) for c in ("overall", "acc")})
    shown = lambda df: {(r.config_id, r.case_id): (round(r.overall, 9), r.judges) for r in df.collect()}
    out = spark.read.parquet(f"{tmp_path}/out/consensus")
    assert shown(out.groupBy("config_id", "case_id").agg(F.max_by("overall", "batch").alias("overall"), F.max_by("judges", "batch").alias("judges"))) == shown(judges.consensus(anew))


def test_conflict_feed_equals_batch(spark, tmp_path):
    v = judges.normalised(fixtures.verdicts(spark, SF)).where("case_id < 40")
    v.write.parquet(f"{tmp_path}/in")
    progress.conflict_feed(spark.readStream.schema(v.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", judges.conflicts).awaitTermination(120)
    key = lambda df: {(r.config_id, r.case_id) for r in df.collect()}
    assert key(spark.read.parquet(f"{tmp_path}/out/consensus")) == key(judges.conflicts(v).where("conflict"))


def test_excerpts_and_claims_over_every_text(spark, tmp_path):
    denial = disclosure.DENIALS[0]
    texts = [None, "", " a\u3000\u00a0b\n\tc ", "é" * 600, "the", "이것은 the " + denial, "the " + "가" * 70 + denial, denial + " t h e", "qua li täts sr\u2003c9", "s t ion"]
    rows = [(i, t, None if i % 4 == 0 else "" if i % 4 == 1 else "src9") for i, t in enumerate(texts)] + [(None, "the tion", "tion")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    excerpts = {r.doc_id: r.excerpt for r in queries.QUERIES["answer_excerpts_all"](spark, str(tmp_path)).collect()}
    assert excerpts == {i: None if t is None else " ".join(t.split())[:500] for i, t, _ in rows}

    def hits(text, claims):
        squeeze, out = lambda x: "".join(x.split()).lower(), []
        for c in filter(None, (x.strip() for x in claims if x)):
            at = text.find(c)
            near = text[max(0, at - 40) : at + len(c) + 60] if at >= 0 else text
            if (at >= 0 or squeeze(c) in squeeze(text)) and not any(d in near for d in disclosure.DENIALS):
                out.append(c)
        return ",".join(dict.fromkeys(out))

    claims = {r.doc_id: r.hits for r in queries.QUERIES["forbidden_claims_all"](spark, str(tmp_path)).collect()}
    assert claims == {i: hits(t or "", ["the", " tion ", "카드번호", s]) for i, t, s in rows}
    assert claims[5] == "" and claims[6] == "the" and len(claims) == len(rows)


def test_lookups_and_procedures_unless_each_is_denied(spark):
    import random
    import re

    lookup, internal = (re.compile(p.replace("(?idU)", "(?i)")) for p in disclosure.CONTEXTUAL.values())
    rng = random.Random(4)
    bits = ["조회 결과", "조회결과", "승인 \u2003결과", "사용내역", "내부", "직원", "절차", "승인", "안내", "제공", "입니다", "확인", "임의", "규정", "\n", "\r", " ", "x" * 25, "y" * 45, "😀" * 11, "불가", disclosure.DENIALS[0]]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(2, 14))) for _ in range(600)] + ["사용 내역 확인" + "z" * 70 + "불가", "사용내역 확인 불가", "사용내역 확인 불가" + "z" * 99 + "사용내역 확인", ""]

    def kinds(t):
        told = any(w in t for w in disclosure.SENSITIVE)
        near = lambda m: t[max(0, m.start() - 40) : m.end() + 60]
        return [k for k, p in zip(disclosure.CONTEXTUAL, (lookup, internal)) if told and any(not any(d in near(m) for d in disclosure.DENIALS) for m in p.finditer(t))]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", disclosure.disclosures(F.col("t")).alias("k"), disclosure.forbidden_hits(F.col("t"), F.array(F.lit("no such"), F.lit("1234"), F.lit(None))).alias("h"), disclosure.forbidden_hits(F.col("t"), F.array(F.lit("no such"))).alias("n")).collect()
    assert {r.i: r.k for r in got} == {i: kinds(t) for i, t in enumerate(texts)}
    assert all(r.h == r.k and r.n == [] for r in got) and {k for r in got for k in r.k} == set(disclosure.CONTEXTUAL)


def test_gram_cosine_is_the_largest_over_sizes(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abA \n\u00a0é") for _ in range(rng.randint(0, 12)))
    rows = [(i, text(), text()) for i in range(200)] + [(900, None, None), (901, "abc", None), (902, "ab", "ab c")]

    def cosine(a, b, n):
        a, b = (Counter([t] if len(t) <= n else [t[i : i + n] for i in range(len(t) - n + 1)]) if t else Counter() for t in ("".join((x or "").lower().split()) for x in (a, b)))
        norms = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return sum(v * b[g] for g, v in a.items()) / norms if norms else 0.0

    df = spark.createDataFrame(rows, "key int, reference string, answer string")
    got = {r.key: r.cosine for r in df.select("key", textsim.gram_cosine(F.col("reference"), F.col("answer")).alias("cosine")).collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert all(abs(got[i] - max(cosine(a, b, n) for n in (2, 3, 4))) < 1e-9 for i, a, b in rows)


def test_claims_of_one_file_are_searched_by_all_tasks(spark, tmp_path):
    rows = [(i, "the 카드 번호 x" if i % 2 else "T H E", "src") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["forbidden_claims_all"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {r.doc_id: r.hits for r in out.collect()} == {i: "the,카드번호" if i % 2 else "the" for i in range(40)}
