"""Two judge runs side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["config_id", "case_id"]
EDGES = (0.0, 5.0, 10.0, 20.0, 30.0)


def compared(base: DataFrame, other: DataFrame, floor: float = 1.0, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Answers that both runs scored, with the difference, also relative to the base (J5, D3). ``more`` are (column, name) of each side to be carried on."""
    names = (("overall", "score"), ("pass", "pass"), *more)
    side = lambda df, p: df.select(*KEY, *[F.col(c).alias(f"{p}_{n}") for c, n in names])
    out = side(base, "base").join(side(other, "other"), KEY).withColumn("delta", F.col("other_score") - F.col("base_score"))
    return out.withColumns({"gap": F.abs("delta"), "relative": F.abs("delta") / F.greatest(F.abs("base_score"), F.lit(floor)) * 100})


def summary(pairs: DataFrame, approximate: bool = False) -> DataFrame:
    """Means, exact quantiles by linear interpolation, signs."""
    # one buffer of distinct gaps for all three; pass approximate=True where gaps are too many for it
    return _quantiles(pairs.agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.avg("gap").alias("mean_gap"), (F.percentile_approx if approximate else F.percentile)("gap", [0.5, 0.9, 0.95]).alias("_q"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"), F.count_if(F.col("base_pass") != F.col("other_pass")).alias("pass_changed")))


def _quantiles(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.get("_q", F.lit(k)) for k, n in enumerate(("median_gap", "p90_gap", "p95_gap"))}).drop("_q")


def marked(base: DataFrame, other: DataFrame, *, mode: str = "points", threshold: float = 0.3, error_types: bool = True, arbiter: DataFrame | None = None, floor: float = 1.0) -> DataFrame:
    """Pairs with whether they differ in gap (points or ``relative_percent``), passing and error type, and what an arbiter said."""
    out = compared(base, other, floor, (("error_type", "error"),))
    out = out.withColumn("selected_gap", F.col("relative") if mode == "relative_percent" else F.col("gap"))
    out = out.withColumns({"gap_met": F.col("selected_gap") >= threshold, "pass_mismatch": F.col("base_pass") != F.col("other_pass"), "error_mismatch": F.col("base_error") != F.col("other_error")})
    out = out.withColumn("conflict", F.col("gap_met") | F.col("pass_mismatch") | (F.col("error_mismatch") if error_types else F.lit(False)))
    if arbiter is None:
        return out.withColumns({"arbiter_score": F.lit(None).cast("double"), "arbiter_pass": F.lit(None).cast("boolean")})
    return out.join(arbiter.select(*KEY, F.col("overall").alias("arbiter_score"), F.col("pass").alias("arbiter_pass")), KEY, "left")


def report(pairs: DataFrame, base: DataFrame, other: DataFrame, approximate: bool = False) -> DataFrame:
    """One row about a comparison: rows of each side, matched and missing; scores, gaps and their quantiles; mismatches, conflicts, what the arbiter settled, final scores.

    The final score of an answer is the mean of both where they agree, the arbiter's where they don't and it spoke. ``approximate`` bounds the memory of the quantiles where gaps are too many.
    """
    quantile = F.percentile_approx if approximate else F.percentile
    agreed = ~F.col("conflict")
    settled = F.col("conflict") & F.col("arbiter_score").isNotNull()
    final = F.when(agreed, (F.col("base_score") + F.col("other_score")) / 2).when(settled, F.col("arbiter_score"))
    passed = F.when(agreed, F.col("base_pass")).when(settled, F.col("arbiter_pass"))
    many = {"candidate_higher": F.col("delta") > 0, "baseline_higher": F.col("delta") < 0, "same_score": F.col("delta") == 0, "gap_met": F.col("gap_met"), "pass_mismatch": F.col("pass_mismatch"), "error_mismatch": F.col("error_mismatch"), "conflict": F.col("conflict"), "arbiter_settled": settled, "arbiter_missing": F.col("conflict") & ~settled, "final_complete": final.isNotNull(), "final_pass": F.coalesce(passed, F.lit(False)), "baseline_pass": F.col("base_pass"), "candidate_pass": F.col("other_pass")}
    means = {"baseline_avg": F.col("base_score"), "candidate_avg": F.col("other_score"), "avg_delta": F.col("delta"), "avg_gap": F.col("gap"), "avg_selected_gap": F.col("selected_gap"), "final_avg": final}
    out = pairs.agg(F.count("*").alias("matched_rows"), *[F.count_if(c).alias(f"{n}_rows") for n, c in many.items()], *[F.avg(c).alias(n) for n, c in means.items()], quantile("gap", [0.5, 0.9, 0.95]).alias("_q"), quantile("selected_gap", 0.9).alias("p90_selected_gap"))
    return _quantiles(out).crossJoin(_sides(base, other))  # single rows


def _sides(base: DataFrame, other: DataFrame) -> DataFrame:
    """How many rows each run has, and how many of them the other lacks: one row from one aggregation on the key. A key with a null matches nothing."""
    sides = base.select(*KEY, F.lit(1).alias("_b"), F.lit(0).alias("_o")).unionByName(other.select(*KEY, F.lit(0).alias("_b"), F.lit(1).alias("_o")))
    keyed = sides.groupBy(*KEY).agg(F.sum("_b").alias("_b"), F.sum("_o").alias("_o"))
    lost = F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull()
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return keyed.agg(total(F.col("_b"), "baseline_source_rows"), total(F.col("_o"), "candidate_source_rows"), total(F.when(lost | (F.col("_o") == 0), F.col("_b")), "missing_candidate_rows"), total(F.when(lost | (F.col("_b") == 0), F.col("_o")), "missing_baseline_rows"))


def by_dimension(pairs: DataFrame, column: str) -> DataFrame:
    """Comparison by model, category or topic, the largest mean change first."""
    out = pairs.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.avg("gap").alias("mean_gap"))
    return out.orderBy(F.desc(F.abs("mean_delta")), "value")


def band_rates(counts: DataFrame) -> DataFrame:
    """Bands with their share of all gaps (A18); a row for each band."""
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(total).withColumn("rate", F.coalesce(F.try_divide(F.col("n"), F.col("_t")), F.lit(0.0))).drop("_t")


def bands(pairs: DataFrame, edges: tuple = EDGES) -> DataFrame:
    """How many gaps fall into each band, empty bands included."""
    spark = pairs.sparkSession
    named = spark.createDataFrame([(i, float(a)) for i, a in enumerate(edges)], "band int, least double")
    band = sum((F.when(F.col("gap") >= e, 1).otherwise(0) for e in edges), F.lit(-1))
    counts = pairs.groupBy(band.cast("int").alias("band")).agg(F.count("*").alias("n"))
    return named.join(counts, "band", "left").select("band", "least", F.coalesce("n", F.lit(0)).alias("n"))


def by_model(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("config_id").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.avg("gap").alias("mean_gap"))


def extremes(pairs: DataFrame, most: int = 30, by_gap: int = 100) -> DataFrame:
    """The largest rises, falls and gaps, ranked (W4). Each is a top-n of all pairs, not a sorted partition."""
    tops = []
    for label, order, n in (("up", F.desc("delta"), most), ("down", F.asc("delta"), most), ("gap", F.desc("gap"), by_gap)):
        top = pairs.orderBy(order, *KEY).limit(n)
        tops.append(top.withColumn("list", F.lit(label)).withColumn("rank", F.row_number().over(Window.orderBy(order, *KEY))))
    return tops[0].unionByName(tops[1]).unionByName(tops[2])
