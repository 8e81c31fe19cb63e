"""Scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gradeflow.functions.columns import blank_to_null
from gradeflow.operators.review import dataset_path_excluded

#: Headers that mean the same column, the preferred first.
ALIASES = {
    "question": ("instruction", "question", "input", "prompt", "query", "user_question", "문제", "주관식 문제", "질문"),
    "gold_answer": ("output", "ground_truth", "answer", "gold_answer", "expected_answer", "expected_output", "reference_answer", "target_answer", "정답", "모범답안", "기준답변"),
    "qa_category": ("qa_category", "category", "source_type", "topic", "대분류", "카테고리"),
    "qa_topic": ("qa_topic", "qa_matrix_topic", "topic", "intent", "source_term", "금융토픽", "출처_용어"),
    "question_type": ("question_type", "qtype", "type", "task_type", "문제유형", "질문유형"),
    "forbidden_claims": ("forbidden_claims", "must_not_include", "hallucination_trap", "hallucination_trap(모델이 꾸미기 쉬운 오답)", "오답_유형"),
    "case_id": ("case_id", "id", "question_id", "qid"),
    "ordinal": ("no", "row_no", "번호"),
}
ANSWER_ALIASES = {
    "case_id": ("case_id", "question_id", "id"),
    "config_id": ("config_id", "model_id", "version"),
    "model_answer": ("model_answer", "answer", "response", "output"),
    "status": ("status",),
    "model": ("model", "model_name"),
    "display_name": ("display_name", "model_display_name"),
    "latency_ms": ("latency_ms",),
    "raw_response": ("raw_response",),
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: bare lower-case names, quoted line breaks, a leading byte order mark."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.toDF(*[c.lstrip("\ufeff").strip().lower() for c in raw.columns])


def picked(raw: DataFrame, names: tuple[str, ...]) -> Column:
    """The first value that is not blank among the columns with these names."""
    return F.coalesce(*[blank_to_null(F.col(f"`{a}`").cast("string")) for a in names if a in raw.columns], F.lit(None).cast("string"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 1 in each file, in the order of its lines.

    A file with quoted line breaks is read by one task, so line order is row order; the file decides,
    so a second file begins at 1 again.
    """
    marked = df.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    return marked.withColumn(name, F.row_number().over(Window.partitionBy("_file").orderBy("_at"))).drop("_file", "_at")


def read_cases(spark: SparkSession, path: str, pool: str, aliases: dict[str, tuple] = ALIASES) -> DataFrame:
    """Questions from CSV with any of the known headers; rows with neither question nor answer are dropped.

    A case without an id is named by its pool and its own number, else by the number of its row in the file, five digits at least.
    """
    raw = numbered(read_table(spark, path), "_row")
    out = raw.select(*[picked(raw, names).alias(n) for n, names in aliases.items() if n != "ordinal"], picked(raw, aliases.get("ordinal", ())).alias("_own"), "_row", F.lit(pool).alias("pool_id"))
    out = out.where("question is not null or gold_answer is not null")
    row = F.col("_row").cast("string")
    place = F.coalesce("_own", F.lpad(row, F.greatest(F.lit(5), F.length(row)), F.lit("0")))
    return out.withColumn("case_id", F.coalesce("case_id", F.concat_ws("-", "pool_id", place))).withColumn("ordinal", F.col("_row")).drop("_own", "_row")


def upload_fault(spark: SparkSession, path: str, aliases: dict[str, tuple] = ALIASES) -> str | None:
    """Why a CSV is no question set: no question column, no answer column, or no row with both."""
    raw = read_table(spark, path)
    for name in ("question", "gold_answer"):
        if not set(raw.columns) & set(aliases[name]):
            return f"no {name} column"
    whole = raw.where(picked(raw, aliases["question"]).isNotNull() & picked(raw, aliases["gold_answer"]).isNotNull())
    return "no row with question and answer" if whole.isEmpty() else None


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line fails the read (S2) or, if not ``strict``, is passed over (S3)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def _there(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return found is not None and len(found) > 0


def read_outputs(spark: SparkSession, run_dir: str, schema: str) -> DataFrame:
    """A run's answers from the folders of its models, else from its one file."""
    parts = f"{run_dir}/by_target_model/*/model_outputs.jsonl"
    return read_jsonl(spark, parts if _there(spark, parts) else f"{run_dir}/model_outputs.jsonl", schema, strict=False)


def read_verdicts(spark: SparkSession, run_dir: str, schema: str) -> DataFrame:
    """A run's verdicts from the folders of its judges: JSON lines, and CSV of judges that have no other (S5). A run without verdicts has no rows."""
    lines, tables = f"{run_dir}/by_judge/*/judge_scores.jsonl", f"{run_dir}/by_judge/*/judge_scores.csv"
    # a judge's file may be a folder of parts
    folder = F.regexp_extract(F.input_file_name(), "/by_judge/([^/]+)/", 1)
    parts = [read_jsonl(spark, lines, schema, strict=False).withColumn("_judge", folder)] if _there(spark, lines) else []
    if _there(spark, tables):
        typed = spark.read.schema(schema).json(spark.sparkContext.emptyRDD()).schema
        raw = read_table(spark, tables).withColumn("_judge", folder)
        read = raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in typed], "_judge")
        parts.append(read.join(F.broadcast(parts[0].select("_judge").distinct()), "_judge", "left_anti") if parts else read)
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.drop("_judge")


def last_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last written."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def read_answers(spark: SparkSession, path: str, cases: DataFrame, default_config: str) -> DataFrame:
    """Answers of models run elsewhere (S7, P47). ``cases`` has case_id and ordinal, its place from 1.

    A row without a case id belongs to the case at its place. Ids that no case has fail the import. Models without a name take that of their config.
    """
    raw = numbered(read_table(spark, path), "_row")
    out = raw.select(*[picked(raw, names).alias(n) for n, names in ANSWER_ALIASES.items()], "_row")
    by_place = cases.select(F.col("case_id").cast("string").alias("_placed"), F.col("ordinal").cast("int").alias("_row"))
    out = out.join(by_place, "_row", "left").withColumn("case_id", F.coalesce("case_id", "_placed"))
    lost = out.join(cases.select(F.col("case_id").cast("string").alias("case_id")), "case_id", "left_anti")
    if unknown := [r[0] for r in lost.select(F.coalesce("case_id", F.concat(F.lit("row_"), F.col("_row")))).limit(8).collect()]:
        raise ValueError(f"unknown cases: {', '.join(unknown)}")
    config = F.coalesce("config_id", F.lit(default_config))
    return out.select("case_id", config.alias("config_id"), F.coalesce("model_answer", F.lit("")).alias("model_answer"), F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("model", config).alias("model"), F.coalesce("display_name", "model", config).alias("display_name"), F.coalesce(F.col("latency_ms").try_cast("double"), F.lit(0.0)).alias("latency_ms"), "raw_response")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(config_id, case_id), each once, from CSV or from JSON lines whose keys may stand in ``context``."""
    if path.endswith(".csv"):
        raw = read_table(spark, path)
        out = raw.select(picked(raw, ("config_id", "version")).alias("config_id"), picked(raw, ("case_id", "question_id")).alias("case_id"))
    else:
        raw = read_jsonl(spark, path, "config_id string, case_id string, context struct<config_id: string, case_id: string>", strict=False)
        out = raw.select(*[F.coalesce(blank_to_null(F.col(c)), blank_to_null(F.col(f"context.{c}"))).alias(c) for c in ("config_id", "case_id")])
    return out.where("config_id is not null and case_id is not null").distinct()


def exploded_verdicts(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A row for each verdict in a column of JSON lists; a row without any keeps none."""
    return rows.withColumn("_v", F.explode(F.from_json(column, f"array<struct<{schema}>>"))).select(*[c for c in rows.columns if c != column], "_v.*")


def discovered(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(dataset_id, role, path, version, bytes) of the CSV files in some folders (S10): the folder names the role; excluded folders and names are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load([f for f in folders if _there(spark, f)]).select("path", "modificationTime", "length")
    folder, name = F.element_at(F.split("path", "/"), -2), F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    role = F.when(F.lower(folder).contains("benchmark"), "benchmark").when(F.lower(folder).contains("regression"), "regression").otherwise("custom")
    out = found.select(F.concat_ws("__", folder, name).alias("dataset_id"), role.alias("role"), "path", F.date_format("modificationTime", "yyyyMMdd_HHmmss").alias("version"), F.col("length").alias("bytes"))
    return out.where(~dataset_path_excluded(F.concat_ws("/", folder, name)))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256 of the bytes, first 16 digits)."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, rows) of files; rows are lines that are not blank."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(path).select(F.input_file_name().alias("_p"), "value").where(F.trim("value") != "").groupBy("_p").agg(F.count("*").alias("rows"))
    # one names files by file:///, the other by file:/
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return files.join(lines, same(F.col("path")) == same(F.col("_p")), "left").select("path", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"))


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with their keys sorted (S14, S21 by appending)."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_table(parts: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """CSV whose header is the union of the parts' columns in the order first seen, quotes doubled (S15). The first name carries a byte order mark."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    flat = out.select(*[F.to_json(f"`{n}`").alias(n) if k.startswith(("array", "struct", "map")) else F.col(f"`{n}`") for n, k in out.dtypes])
    flat.toDF("\ufeff" + flat.columns[0], *flat.columns[1:]).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, kind: str = "json", mode: str = "errorifexists") -> None:
    """A folder for each model or judge (S16, S17); ``mode`` append for checkpoints (S21). The column stays in the rows too."""
    df.withColumn(f"by_{by}", F.col(by)).write.mode(mode).partitionBy(f"by_{by}").format(kind).save(path)


def write_named(df: DataFrame, path: str, root: str, by: str, name: str) -> list[str]:
    """One folder of JSON lines for each model or judge, ``path/root/<value>/<name>``, as the scans of a run expect them.

    Spark writes ``by=<value>`` folders in one job; each is then moved to its name, replacing what a
    former run of that model or judge left there and nothing else. Returns the values, in order;
    they are models or judges, so few. Rows without a value belong to no folder and fail the write.
    """
    spark = df.sparkSession
    if not df.where(F.col(by).isNull()).isEmpty():
        raise ValueError(f"rows without {by}")
    made = f"{path}/_made-{root}-{name}"
    df.select(*sorted(df.columns), F.col(by).alias("_by")).write.mode("overwrite").partitionBy("_by").json(made)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(made).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    values = []
    for found in files.listStatus(hadoop(made)):
        folder = found.getPath().getName()
        if not folder.startswith("_by="):
            continue
        values.append(spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder[4:]))
        target = hadoop(f"{path}/{root}/{folder[4:]}/{name}")
        files.mkdirs(target.getParent())
        files.delete(target, True)
        if not files.rename(found.getPath(), target):
            raise OSError(f"cannot move {found.getPath()} to {target}")
    files.delete(hadoop(made), True)
    return sorted(values)


def write_target_parts(outputs: DataFrame, path: str, excerpt: Callable[[Column], Column]) -> list[str]:
    """A run's answers by model: as they are, with normalised excerpts, and raw responses (S16, P25). ``read_outputs`` reads them back."""
    root, key = "by_target_model", ("config_id", "case_id")
    models = write_named(outputs, path, root, "config_id", "model_outputs.jsonl")
    write_named(outputs.select(*key, "status", excerpt(F.col("model_answer")).alias("answer_excerpt")), path, root, "config_id", "normalized_answers.jsonl")
    if "raw_response" in outputs.columns:
        write_named(outputs.where("raw_response is not null").select(*key, "status", "raw_response"), path, root, "config_id", "raw_responses.jsonl")
    return models


def write_judge_parts(verdicts: DataFrame, responses: DataFrame, failures: DataFrame, path: str) -> list[str]:
    """A run's verdicts, raw responses and failures by judge (S17). ``read_verdicts`` reads the verdicts back."""
    for df, name in ((responses, "judge_raw_responses"), (failures, "judge_failures")):
        write_named(df, path, "by_judge", "judge_id", f"{name}.jsonl")
    return write_named(verdicts, path, "by_judge", "judge_id", "judge_scores.jsonl")


def write_run(tables: dict[str, DataFrame], path: str, csv: tuple[str, ...] = ()) -> DataFrame:
    """A run's tables as JSON lines, some also as CSV, and a manifest with their counts."""
    for name, df in tables.items():
        write_lines(df, f"{path}/{name}.jsonl")
        if name in csv:
            write_table([df], f"{path}/{name}.csv")
    made = manifest(tables)
    write_lines(made, f"{path}/manifest")
    return made


def manifest(tables: dict[str, DataFrame], ids: tuple[str, ...] = ("config_id", "judge_id")) -> DataFrame:
    """(table, rows, and the sorted ids of each kind that a table has): a row for each table (S20). Ids are models and judges, so few."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), *[(F.array_sort(F.collect_set(c)) if c in df.columns else F.lit(None).cast("array<string>")).alias(f"{c}s") for c in ids]) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and what makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def point_to(spark: SparkSession, path: str, run_id: str) -> None:
    """Make ``run_id`` the current run of ``path``: a further numbered pointer, moved to its place whole, so that readers see the former run or this one."""
    files, make = _hadoop(spark, path)
    files.mkdirs(make(f"{path}/current"))
    known = [f.getPath().getName() for f in files.listStatus(make(f"{path}/current"))]
    draft = make(f"{path}/_pointer-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(run_id.encode())
    out.close()
    number = max((int(n) for n in known if n.isdigit()), default=0) + 1
    # another writer may have taken the number
    while files.exists(target := make(f"{path}/current/{number:010d}")) or not files.rename(draft, target):
        number += 1


def current_run(spark: SparkSession, path: str) -> str:
    """The run that the latest pointer names."""
    files, make = _hadoop(spark, path)
    number = max(n for f in files.listStatus(make(f"{path}/current")) if (n := f.getPath().getName()).isdigit())
    return spark.read.text(f"{path}/current/{number}", wholetext=True).first()[0]


def write_run_tables(tables: dict[str, DataFrame], path: str, run_id: str) -> dict[str, int]:
    """A run's tables in folders of its own (``path/runs/<run>/<table>``); rows are counted as they are written."""
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/runs/{run_id}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def export_current(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Write a run's tables beside those of other runs, then point to them (S19); until then readers see the former run whole."""
    write_run_tables(tables, path, run_id)
    point_to(next(iter(tables.values())).sparkSession, path, run_id)


def read_current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current run."""
    return spark.read.parquet(f"{path}/runs/{current_run(spark, path)}/{name}")


def hashed_shard(key: Column) -> Column:
    """The two-digit shard of a cache key."""
    return F.substring(key, 1, 2)


def store_answers(answers: DataFrame, path: str) -> None:
    """Add good answers to the cache, by namespace and shard (S22). Takes namespace and cache_key."""
    good = answers.where((F.col("status") == "ok") & blank_to_null(F.col("model_answer")).isNotNull())
    good.withColumn("shard", hashed_shard(F.col("cache_key"))).write.mode("append").partitionBy("namespace", "shard").parquet(path)


def store_verdicts(verdicts: DataFrame, path: str, role: str = "judge") -> None:
    """Add usable verdicts to the cache, by role, namespace and shard: with a judge, a reason and a metric (S23). An arbiter's namespace names the judges it settles between."""
    told = blank_to_null(F.col("judge_id")).isNotNull() & blank_to_null(F.col("reason")).isNotNull() & F.coalesce("acc", "com", "nac", "hal_pass").isNotNull()
    space = F.concat_ws("+", "namespace", F.array_join(F.array_sort("base_judges"), "+")) if role == "arbiter" else F.col("namespace")
    kept = verdicts.where(told).withColumns({"role": F.lit(role), "namespace": space, "shard": hashed_shard(F.col("cache_key"))})
    kept.write.mode("append").partitionBy("role", "namespace", "shard").parquet(path)


def load_cached(spark: SparkSession, path: str, namespace: str, wanted: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """Cached rows of a namespace, of the wanted keys if given; other namespaces and, at run time, other shards stay unread."""
    cache = spark.read.parquet(path).where(F.col("namespace") == namespace)
    if role:
        cache = cache.where(F.col("role") == role)
    if wanted is None:
        return cache
    keys = wanted.select("cache_key").distinct().withColumn("shard", hashed_shard(F.col("cache_key")))
    return cache.join(keys, ["shard", "cache_key"], "left_semi")


def answers_template(cases: DataFrame, config_id: str, *, model: str | None = None, display_name: str | None = None, most: int = 100_000) -> DataFrame:
    """Rows to be filled with the answers of a model run elsewhere: the first cases by id."""
    name = model or config_id
    blank = {"config_id": config_id, "model": name, "display_name": display_name or name, "model_answer": "", "status": "ok", "latency_ms": "", "raw_response": ""}
    return cases.withColumns({k: F.lit(v) for k, v in blank.items()}).orderBy("case_id").limit(min(most, 100_000))
