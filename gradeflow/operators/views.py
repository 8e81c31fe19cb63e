"""Filtered, searched and ordered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def searched(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in any of ``columns``, capitals or not."""
    return df.where(F.lower(F.concat_ws("\u0001", *columns)).contains(text.lower()))


def disagreeing(scores: DataFrame, spread: float = 0.15) -> DataFrame:
    """Cases on which the models differ in passing or by a spread of scores."""
    out = scores.groupBy("case_id").agg(F.count_distinct("pass").alias("outcomes"), (F.max("overall") - F.min("overall")).alias("spread"))
    return out.where((F.col("outcomes") > 1) | (F.col("spread") >= spread))


def result_matrix(scores: DataFrame, review: Column, most: int = 120) -> DataFrame:
    """Cases with failures first, then those under review, then by the worst score (K1)."""
    out = scores.groupBy("case_id").agg(F.max((~F.col("pass")).cast("int")).alias("has_failure"), F.max(review.cast("int")).alias("has_review"), F.min("overall").alias("worst"))
    return out.orderBy(F.desc("has_failure"), F.desc("has_review"), "worst", "case_id").limit(most)


def profile(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """The most frequent values of each column."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])).alias("p")).select("p.*")
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return pairs.groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def profile_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(flag, n): the total and how many rows each flag holds for (A22), in one pass."""
    out = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return out.select(F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in ("total", *flags)])).alias("e")).select("e.*")


def failing(threshold: float = 0.6) -> Column:
    """Whether a row failed or lies below the threshold."""
    return ~F.col("pass") | (F.col("overall") < threshold)


def shown_error() -> Column:
    """The error type that a row is listed under; a failure is never listed as normal."""
    e = F.col("error_type")
    return F.when(failing() & (e == "normal"), "partial_inaccuracy").when(failing() & e.isin("ungrounded_answer", "evidence_context_echo"), "unsupported_claim").otherwise(e)


def of_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Rows of a view: all, failures, passes, safety, review or different (F5); takes release_gate and error_type."""
    e = F.col("error_type")
    if mode == "different":
        return rows.join(disagreeing(rows).select("case_id"), "case_id", "left_semi")
    test = {"all": F.lit(True), "failures": failing(), "passes": ~failing(), "safety": (F.col("release_gate") == "block") | e.contains("unsafe") | e.contains("policy") | e.contains("privacy"), "review": F.col("release_gate").isin("block", "review")}
    return rows.where(test[mode])


def failure_distribution(rows: DataFrame) -> DataFrame:
    """Failures by shown type: how many, models, mean score, the worst case."""
    bad = rows.where(failing()).withColumn("type", shown_error())
    return bad.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("config_id").alias("models"), F.avg("overall").alias("average"), F.min_by("case_id", F.struct("overall", "case_id", "config_id")).alias("worst_case"))


def heat_matrix(rows: DataFrame, down: str, across: str) -> DataFrame:
    """Cells of two dimensions with the place of each value by frequency, unknown last.

    One aggregation to cells; places come from the few cells, not from the rows.
    """
    known = rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in (down, across)})
    cells = known.groupBy(down, across).agg(F.count("*").alias("n"), F.avg("overall").alias("average"))
    for c in (down, across):
        sums = cells.groupBy(c).agg(F.sum("n").alias("_t"))
        # a row for each value of one dimension
        place = sums.withColumn(f"{c}_place", F.row_number().over(Window.orderBy(F.col(c) == "unknown", F.desc("_t"), c))).drop("_t")
        cells = cells.join(place, c)
    return cells


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """Mean score, pass rate and distinct cases by any column."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"), F.avg("overall").alias("average"), F.avg(F.col("pass").cast("int")).alias("pass_rate"))


def judge_buckets(verdicts: DataFrame, arbiter: DataFrame) -> DataFrame:
    """Each judge's average and pass rate on each model; the arbiter is a bucket of its own."""
    all_ = verdicts.select("config_id", "judge_id", "overall", "pass").unionByName(arbiter.select("config_id", F.lit("arbiter").alias("judge_id"), "overall", "pass"))
    return all_.groupBy("config_id", "judge_id").agg(F.count("*").alias("n"), F.avg("overall").alias("average"), F.avg(F.col("pass").cast("int")).alias("pass_rate"))


def head_to_head(summary: DataFrame, left: str, right: str, tie: float = 0.05) -> DataFrame:
    """Two models of a summary (config_id, average, pass_rate) against each other."""
    side = lambda c, p: summary.where(F.col("config_id") == c).select(*[F.col(x).alias(f"{p}_{x}") for x in ("config_id", "average", "pass_rate")])
    out = side(left, "left").crossJoin(side(right, "right"))  # one row each
    gap = F.col("left_average") - F.col("right_average")
    return out.select("left_config_id", "right_config_id", gap.alias("score_delta"), (F.col("left_pass_rate") - F.col("right_pass_rate")).alias("pass_rate_delta"), F.when(F.abs(gap) < tie, "tie").when(gap > 0, F.col("left_config_id")).otherwise(F.col("right_config_id")).alias("winner"))


def overview(models: DataFrame) -> DataFrame:
    """All models in one row: mean of means, largest total, worst gate (A26, A27); takes config_id, n, average, pass_rate, release_gate."""
    worst = F.min_by("release_gate", F.struct(gate_rank(F.col("release_gate")), "release_gate"))
    return models.agg(F.count("*").alias("models"), F.max("n").alias("total"), F.avg("average").alias("average"), F.avg("pass_rate").alias("pass_rate"), worst.alias("worst_gate"))


def gate_rank(gate: Column) -> Column:
    """Blocked before review before passed before the rest (K7)."""
    return F.when(gate == "block", 0).when(gate == "review", 1).when(gate == "pass", 2).otherwise(3)


def watch_list(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Cases to watch: failed, fallen or held back, by gate, change and accuracy (K8); takes score_delta and release_gate."""
    low = (F.col("acc") < threshold) | failing(threshold) | (F.col("score_delta") < 0) | F.col("release_gate").isin("block", "review")
    return rows.where(low).orderBy(gate_rank(F.col("release_gate")), "score_delta", "acc", "config_id", "case_id")


def regression_kpis(rows: DataFrame) -> DataFrame:
    """Watched, fallen and failed cases and the worst fall."""
    low = failing() | (F.col("score_delta") < 0) | (F.col("acc") < 0.6) | F.col("release_gate").isin("block", "review")
    return rows.agg(F.count_if(low).alias("watched"), F.count_if(F.col("score_delta") < 0).alias("fallen"), F.count_if(failing()).alias("failed"), F.least(F.min("score_delta"), F.lit(0.0)).alias("worst_fall"))


#: What orders rows last, so that no two are alike: (name, descending).
BY_SCORE = (("overall", False), ("config_id", False), ("case_id", False))


def page_after(rows: DataFrame, order: tuple, after: dict | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the key ``after`` in ``order``, the first ones without a key (K2, K4, K5).

    ``order`` lists (column, descending); nulls come last. The key is a predicate on the rows and every task keeps
    its first ``size`` ones, so a deep page costs what the first one does, and rows that come or go on
    earlier pages shift nothing. Rows with equal keys count as one place: end the order with the ids.
    """
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for name, down in order:
            c, at = F.col(name), after[name]
            if at is not None:
                behind = behind | (same & (((c < F.lit(at)) if down else (c > F.lit(at))) | c.isNull()))
            same = same & c.eqNullSafe(F.lit(at))
        rows = rows.where(F.coalesce(behind, F.lit(False)))
    return rows.orderBy(*[F.desc_nulls_last(name) if down else F.asc_nulls_last(name) for name, down in order]).limit(size)


def last_key(page: DataFrame, order: tuple) -> dict | None:
    """The key of a page's last row, for the page after it; null for a page without rows. A page is small."""
    found = page.select(*[name for name, _ in order]).tail(1)
    return found[0].asDict() if found else None


def worst_first(rows: DataFrame, after: dict | None = None, size: int = 40) -> DataFrame:
    """A page of failures by score (K2, K6)."""
    return page_after(rows.where(failing()), BY_SCORE, after, size)


def preview(cases: DataFrame, most: int, by: str = "question_type") -> DataFrame:
    """Up to ``most`` cases in turn from each kind.

    No kind gives more than ``most`` rows, so each is cut by a top-n of its own window first.
    """
    kind = F.coalesce(by, F.lit("unknown"))
    ranked = cases.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy("case_id"))).where(F.col("_n") <= most)
    first = ranked.where("_n = 1").select(kind.alias("_kind"), F.col("case_id").alias("_first"))
    return ranked.withColumn("_kind", kind).join(first, "_kind").orderBy("_n", "_first").limit(most).drop("_n", "_kind", "_first")


def inventory(verdicts: DataFrame) -> DataFrame:
    """Rows and usable rows of each judge."""
    return verdicts.groupBy("judge_id").agg(F.count("*").alias("rows"), F.count_if(F.col("overall").isNotNull()).alias("usable"), F.count_distinct("config_id").alias("models"))


def faceted(rows: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """Rows with one of the chosen values in each facet; a facet without a choice leaves out only unknown values."""
    for name, values in facets.items():
        held = F.coalesce(name, F.lit("unknown"))
        rows = rows.where(held.isin(*values) if values else held != "unknown")
    return rows


def done_counts(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct answers done for each model and their share of the cases."""
    total = cases.agg(F.count_distinct("case_id").alias("total"))  # one row
    return rows.groupBy("config_id").agg(F.count_distinct("case_id").alias("done")).crossJoin(total).withColumn("percent", F.try_divide(F.col("done") * 100.0, F.col("total")))


def id_faults(rows: DataFrame, key: str) -> DataFrame:
    """(fault, id, n): ids that occur more than once, and how many rows have a blank id."""
    known = F.coalesce(F.trim(F.col(key).cast("string")), F.lit(""))
    counts = rows.groupBy(known.alias("id")).agg(F.count("*").alias("n"))
    return counts.where("id = '' or n > 1").select(F.when(F.col("id") == "", "blank").otherwise("duplicate").alias("fault"), "id", "n")


def run_list(models: DataFrame) -> DataFrame:
    """A row for each run from the rows of its models: mean of their scores, largest total, mean of rates, worst gate, newest first."""
    worst = F.min_by("release_gate", F.struct(gate_rank(F.col("release_gate")), "release_gate"))
    out = models.groupBy("run_id").agg(F.count("*").alias("models"), F.max("n").alias("total"), F.avg("average").alias("average"), F.avg("pass_rate").alias("pass_rate"), worst.alias("worst_gate"), F.max("started_at").alias("started_at"))
    return out.orderBy(F.desc("started_at"), "run_id")


def weakest_cells(rows: DataFrame, dims: tuple[str, str, str], least: int = 5, most: int = 30) -> DataFrame:
    """Cells of three dimensions by their mean score, the weakest first, with whether they hold enough cases to say so."""
    known = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in dims})
    cells = known.groupBy(*dims).agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"), F.avg("overall").alias("average"), F.avg(F.col("pass").cast("int")).alias("pass_rate"))
    return cells.withColumn("reliability", F.when(F.col("cases") >= least, "reliable").otherwise("low_sample")).orderBy("average", *dims).limit(most)


def repeated_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each id with how often the id occurs; blank ids have no row."""
    known = rows.where(F.trim(F.col(key).cast("string")) != "")
    return known.groupBy(key).agg(F.count("*").alias("times"), F.max(order).alias("kept"))
