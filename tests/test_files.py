"""Scans and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import compose, facts, review
from gradeflow.sources import files


def test_question_csv_of_two_files_and_many_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿번호,Query,정답,must_not_include\n7,"a\nb",c,x\n,q2,,\n,,,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("번호,Query,정답,must_not_include\n,q3,d,\n", encoding="utf-8")
    got = {(r.case_id, r.question, r.gold_answer, r.forbidden_claims) for r in files.read_cases(spark, str(tmp_path), "p").collect()}
    assert got == {("p-7", "a\nb", "c", "x"), ("p-00002", "q2", None, None), ("p-00001", "q3", "d", None)}
    assert files.upload_fault(spark, str(tmp_path / "a.csv")) is None
    (tmp_path / "c").mkdir()
    for text, fault in (("question,x\nq,1\n", "no gold_answer column"), ("y,answer\nq,1\n", "no question column"), ("question,answer\nq,\n,a\n", "no row with question and answer")):
        (tmp_path / "c" / "c.csv").write_text(text)
        assert files.upload_fault(spark, str(tmp_path / "c" / "c.csv")) == fault


def test_outputs_and_verdicts_by_folder(spark, tmp_path):
    run = tmp_path / "run"
    (run / "by_target_model" / "m0").mkdir(parents=True)
    (run / "by_target_model" / "m0" / "model_outputs.jsonl").write_text('{"config_id": "m0", "case_id": 1}\n{bad\n')
    (run / "model_outputs.jsonl").write_text('{"config_id": "flat", "case_id": 2}\n')
    kind = "config_id string, case_id int"
    assert [tuple(r) for r in files.read_outputs(spark, str(run), kind).collect()] == [("m0", 1)]
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "model_outputs.jsonl").write_text('{"config_id": "flat", "case_id": 2}\n')
    assert [tuple(r) for r in files.read_outputs(spark, str(tmp_path / "flat"), kind).collect()] == [("flat", 2)]
    for judge in ("j0", "j1"):
        (run / "by_judge" / judge).mkdir(parents=True)
        (run / "by_judge" / judge / "judge_scores.csv").write_text("config_id,case_id,more\nm9,9,x\n")
    (run / "by_judge" / "j0" / "judge_scores.jsonl").write_text('{"config_id": "m0", "case_id": 1}\n')
    assert sorted(map(tuple, files.read_verdicts(spark, str(run), kind).collect())) == [("m0", 1), ("m9", 9)]


def test_answers_and_keys_of_others(spark, tmp_path):
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, ordinal int")
    (tmp_path / "x.csv").write_text("id,Response,version,latency_ms\n,hello,,12\nb,,v2,x\n")
    got = sorted((r.case_id, r.config_id, r.model_answer, r.status, r.model, r.latency_ms) for r in files.read_answers(spark, str(tmp_path / "x.csv"), cases, "ext").collect())
    assert got == [("a", "ext", "hello", "ok", "ext", 12.0), ("b", "v2", "", "ok", "v2", 0.0)]
    (tmp_path / "y.csv").write_text("id,answer\nzz,hello\n")
    with pytest.raises(ValueError, match="zz"):
        files.read_answers(spark, str(tmp_path / "y.csv"), cases, "ext")
    (tmp_path / "k.jsonl").write_text('{"config_id": "m", "case_id": "1"}\n{"context": {"config_id": "m", "case_id": "1"}}\n{"context": {"case_id": "2"}}\nnone\n')
    assert [tuple(r) for r in files.read_keys(spark, str(tmp_path / "k.jsonl")).collect()] == [("m", "1")]
    (tmp_path / "k.csv").write_text("version,question_id\nm,3\nm,3\n,4\n")
    assert [tuple(r) for r in files.read_keys(spark, str(tmp_path / "k.csv")).collect()] == [("m", "3")]


def test_datasets_are_found_and_listed(spark, tmp_path):
    for name in ("benchmark/a.csv", "regression/b.csv", "regression/old-b.csv", "benchmark_archive/c.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("question,answer\n\nq,a\n")
    folders = [str(tmp_path / f) for f in ("benchmark", "regression", "benchmark_archive", "nowhere")]
    found = files.discovered(spark, folders)
    assert sorted((r.dataset_id, r.role, r.bytes) for r in found.collect()) == [("benchmark__a", "benchmark", 21), ("regression__b", "regression", 21)]
    listed = found.where("role = 'benchmark'").withColumn("dataset_id", F.lit("named"))
    assert sorted((r.dataset_id, r.discovered) for r in compose.catalogue(found, listed).collect()) == [("named", False), ("regression__b", True)]
    assert [r.dataset_id for r in review.not_catalogued(found, listed).collect()] == ["regression__b"]
    pools = compose.runtime_pools(listed.select("dataset_id", "path", "role"), found, found.select("path", F.lit(1).alias("rows")))
    members = compose.profiles(pools, compose.role_defaults(pools, {"regression": "named"}))
    assert sorted((r.profile_id, r.dataset_id) for r in members.collect()) == [("default_benchmark", "named"), ("default_regression", "regression__b"), ("registered_benchmark_all", "named"), ("registered_regression_all", "regression__b")]
    assert compose.profile_pools(pools, members, "registered_regression_all") == [compose.Pool("regression__b", 1, role="regression", gate_eligible=True, prefix="regression__b")]
    r = files.inventory(spark, str(tmp_path / "benchmark" / "a.csv")).first()
    assert (r.bytes, r.rows, len(r.sha256)) == (21, 2, 64)
    assert files.fingerprint(spark, str(tmp_path / "benchmark" / "a.csv")).first().fingerprint == r.sha256[:16]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m0", 1, "j0", 'say "x"', [1, 2]), ("m1", 2, "j1", None, None)], "config_id string, case_id int, judge_id string, model_answer string, notes array<int>")
    made = files.write_run({"scores": df, "outputs": df.drop("notes")}, str(tmp_path / "run"), csv=("scores",))
    assert {(r.table, r.rows, tuple(r.config_ids), tuple(r.judge_ids)) for r in made.collect()} == {("scores", 2, ("m0", "m1"), ("j0", "j1")), ("outputs", 2, ("m0", "m1"), ("j0", "j1"))}
    lines = [x for p in sorted((tmp_path / "run" / "scores.jsonl").glob("part*")) for x in p.read_text().splitlines()]
    assert list(json.loads(lines[0])) == sorted(df.columns)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "run" / "scores.csv").glob("part*")))
    assert raw.startswith("﻿config_id,".encode())
    back = files.read_table(spark, str(tmp_path / "run" / "scores.csv"))
    assert {(r.config_id, r.model_answer, r.notes) for r in back.collect()} == {("m0", 'say "x"', "[1,2]"), ("m1", None, None)}
    files.write_table([df.select("case_id"), df.select("judge_id")], str(tmp_path / "union"))
    assert files.read_table(spark, str(tmp_path / "union")).columns == ["case_id", "judge_id"]
    answers = df.drop("judge_id", "notes").withColumns({"status": F.lit("ok"), "raw_response": F.lit("r")}).replace("m1", "m/ 1=x")
    run, kind = str(tmp_path / "t"), "config_id string, case_id int, model_answer string"
    assert files.write_target_parts(answers, run, facts.excerpt) == ["m/ 1=x", "m0"]
    assert spark.read.json(f"{run}/by_target_model/m0/normalized_answers.jsonl").first().answer_excerpt == 'say "x"'
    read = lambda: {tuple(r) for r in files.read_outputs(spark, run, kind).collect()}
    assert read() == {("m0", 1, 'say "x"'), ("m/ 1=x", 2, None)}
    # a model that runs again replaces its own answers and no others
    files.write_target_parts(answers.where("config_id = 'm0'").withColumn("case_id", F.lit(7)), run, facts.excerpt)
    assert read() == {("m0", 7, 'say "x"'), ("m/ 1=x", 2, None)}
    kind = "config_id string, case_id int, judge_id string"
    assert files.read_verdicts(spark, run, kind).count() == 0
    assert files.write_judge_parts(df, df.limit(1), df.limit(0), run) == ["j0", "j1"]
    assert {tuple(r) for r in files.read_verdicts(spark, run, kind).collect()} == {("m0", 1, "j0"), ("m1", 2, "j1")}
    with pytest.raises(ValueError, match="without judge_id"):
        files.write_judge_parts(df.withColumn("judge_id", F.lit(None).cast("string")), df, df, run)
    for name in ("r1", "r2"):
        files.export_current({"scores": df}, str(tmp_path / "now"), name)
        assert files.current_run(spark, str(tmp_path / "now")) == name and files.read_current(spark, str(tmp_path / "now"), "scores").count() == 2


def test_caches_keep_good_rows_by_shard(spark, tmp_path):
    rows = [("n", "aa1", "ok", "x"), ("n", "ab2", "ok", " "), ("n", "ac3", "error", "y"), ("o", "aa1", "ok", "z")]
    answers = spark.createDataFrame(rows, "namespace string, cache_key string, status string, model_answer string")
    files.store_answers(answers, str(tmp_path / "a"))
    assert [r.model_answer for r in files.load_cached(spark, str(tmp_path / "a"), "n").collect()] == ["x"]
    assert [r.model_answer for r in files.load_cached(spark, str(tmp_path / "a"), "o", answers.select("cache_key")).collect()] == ["z"]
    verdicts = spark.createDataFrame([("n", "aa1", "j0", "why", 1.0, ["b", "a"]), ("n", "ab1", "j0", "", 1.0, ["a"]), ("n", "ac1", None, "why", 1.0, ["a"]), ("n", "ad1", "j0", "why", None, ["a"])], "namespace string, cache_key string, judge_id string, reason string, acc double, base_judges array<string>").selectExpr("*", "acc as com", "acc as nac", "acc as hal_pass")
    for role in ("judge", "arbiter"):
        files.store_verdicts(verdicts, str(tmp_path / "v"), role)
    assert [r.cache_key for r in files.load_cached(spark, str(tmp_path / "v"), "n", role="judge").collect()] == ["aa1"]
    assert [r.cache_key for r in files.load_cached(spark, str(tmp_path / "v"), "n+a+b", verdicts, role="arbiter").collect()] == ["aa1"]


def test_composition(spark):
    cases = spark.createDataFrame([("p", "1", 1, "active", True), ("p", "1", 2, "active", False), ("p", "2", 3, "shadow", True), ("q", "1", 1, "active", True), ("q", "3", 2, "active", False), ("r", "4", 1, "shadow", False)], "pool_id string, case_id string, ordinal int, case_status string, gold_verified boolean")
    pools = [compose.Pool("p", 1, role="benchmark", prefix="B", defaults={"lang": "ko"}), compose.Pool("q", 1), compose.Pool("r", 1)]
    got = {r.dataset_pool_id: r for r in compose.composed(cases, pools, seed="s").collect()}
    assert (got["p"].case_id, got["p"].source_case_id, got["p"].lang, got["p"].gate_eligible, got["p"].gold_verified) == ("B::1", "1", "ko", False, True)
    assert got["q"].case_id == "3" and got["q"].human_review_required and got["r"].case_status == "shadow" and not got["r"].release_gate_eligible
    with pytest.raises(ValueError):
        compose.composed(cases, [compose.Pool("p", 2)], seed="s")
    assert [p.pool_id for p in compose.all_registered(pools, "regression")] == ["q", "r"]
    one = spark.createDataFrame([("a", 1)], "case_id string, x int")
    two = spark.createDataFrame([("a", 2), ("b", 3)], "case_id string, x int")
    assert sorted(map(tuple, compose.first_source([one, two]).collect())) == [("a", 1), ("b", 3)]
    made = spark.createDataFrame([(None, "q1"), ("i", "q2")], "id string, question string")
    ids = [r[0] for r in made.select(compose.case_ids(made)).collect()]
    assert ids[1] == "i" and ids[0].startswith("COMPOSED-") and len(ids[0]) == 21 and ids[0] == ids[0].upper()
