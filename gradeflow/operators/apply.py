"""Judge verdicts applied to deterministic scores, and saved runs blended anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.columns import METRICS, PASS_THRESHOLD

PARTS = (*METRICS, "overall", "critical_fail", "pass", "error_type")
KEY = ["config_id", "case_id"]


def attached(static: DataFrame, judged: DataFrame) -> DataFrame:
    """Both scores of each answer side by side as static_* and judge_*; answers without a verdict stay."""
    side = lambda df, p: df.select(*KEY, *[F.col(c).alias(f"{p}_{c}") for c in PARTS])
    return side(static, "static").join(side(judged, "judge"), KEY, "left")


def applied(both: DataFrame, mode: str = "audit", weight: float = 0.5, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """The final score of each answer.

    ``audit`` keeps the deterministic score, ``override`` takes the judges', ``blend`` mixes both by
    ``weight``, held to 0..1; a metric that the judges leave out enters the mix as 0 (D14), and the
    judges' error type counts where the mix fails. Answers without a verdict keep their score.
    """
    w = min(1.0, max(0.0, weight))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mixed = lambda c: zero(f"static_{c}") * (1 - w) + zero(f"judge_{c}") * w
    told = F.col("judge_overall").isNotNull()
    if mode == "audit":
        return both.withColumns({c: F.col(f"static_{c}") for c in PARTS})
    if mode == "override":
        new = {c: F.col(f"judge_{c}") for c in (*METRICS, "overall", "critical_fail", "error_type")}
    elif mode == "blend":
        new = {c: mixed(c) for c in (*METRICS, "overall")}
        new["critical_fail"] = F.coalesce("static_critical_fail", F.lit(False)) | F.coalesce("judge_critical_fail", F.lit(False))
    else:
        raise ValueError(f"unknown mode {mode}")
    passed = (new["overall"] >= threshold) & ~F.coalesce(new["critical_fail"], F.lit(False))
    if mode == "blend":
        new["error_type"] = F.when(~passed & (F.col("judge_error_type") != "normal"), F.col("judge_error_type")).otherwise(F.col("static_error_type"))
    new["pass"] = passed
    return both.withColumns({c: F.when(told, x).otherwise(F.col(f"static_{c}")) for c, x in new.items()})


def reblended(saved: DataFrame, mode: str, weight: float, threshold: float) -> DataFrame:
    """A saved run under another mode, weight or threshold, from its stored parts; nothing is scored again.

    Under ``audit`` pass follows from the stored score and the new threshold.
    """
    out = applied(saved.drop(*PARTS), mode, weight, threshold)
    return out.withColumn("pass", (F.col("overall") >= threshold) & ~F.coalesce("critical_fail", F.lit(False)))
