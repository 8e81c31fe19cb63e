"""Judges' raw answers: extraction, checks, normalised verdicts, responses and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.columns import METRICS, applicable_mean, error_type, names_error_type, parse_bool, passes, raw_metrics, score01, squeezed
from gradeflow.operators.textsim import numbers

KEY = ("config_id", "case_id")

# The raw scores that a judge may give, and the fields of its answer.
RAW_SCORES = {"accuracy": (0, 1, 2), "completeness": (-1, 0, 1, 2), "numerical_accuracy": (-1, 0, 1), "hallucination": (0, 1)}
FIELDS = ("critical_fail", "error_type", "reason", "confidence", "evidence_notes")
NUMERIC_TYPE, NUMERIC_MARKS = "수치추론/계산", ("numeric", "amount", "rate")


def extracted(raw: Column) -> Column:
    """The text from the first brace to the last, whatever stands around it; null without one (P15). Linear in the text."""
    first, behind = F.locate("{", raw), F.locate("}", F.reverse(raw))
    last = F.length(raw) - behind + 1
    return F.when((first > 0) & (behind > 0) & (last > first), F.substring(raw, first, last - first + 1))


def parsed_object(text: Column) -> Column:
    """A text that is one JSON object and nothing else, as a variant; null for all other texts.

    The parser stops behind the first value. So the text is parsed as the only element of an array, and must
    also do as the only field of an object: what closes one of them early breaks the other. Objects that
    repeat a name, numbers of more than 1,000 digits and nesting deeper than 1,000 are no JSON here.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    found = F.try_variant_get(listed, "$[0]", "variant")
    return F.when(whole & F.schema_of_variant(found).startswith("OBJECT"), found)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _whole(v: Column) -> Column:
    """A whole number given as number or text; a boolean, a fraction and all else are none."""
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    kind = _kind(v)
    of_text = F.when(text.rlike(r"(?U)^\s*-?\d+\s*$"), F.regexp_replace(text, r"(?U)\s", "").try_cast("long"))
    return F.when(kind == "STRING", of_text).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (number == F.floor(number)), number.try_cast("long"))


def _confidence(v: Column) -> Column:
    text, kind = F.try_variant_get(v, "$", "string"), _kind(v)
    number = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(kind != "STRING", F.try_variant_get(v, "$", "double")).when(text.rlike(r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"), text.try_cast("double"))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number, F.lit(0.0)))), 4)


def checked(answers: DataFrame, raw: str = "raw", scores: str = "scores") -> DataFrame:
    """``answers`` with what a judge's raw answer says, and why it can't be used: ``invalid``, null for good ones.

    A good answer has the fields ``FIELDS`` and the object ``scores`` with the fields of ``RAW_SCORES``,
    no others, whole numbers among the allowed ones, a boolean ``critical_fail``, a known error type,
    a reason and a list of notes. The first fault is named. Bad answers, null ones too, have no
    values; an object that repeats a field has the fault ``repeated fields``. Variants tell 1, 1.0, true
    and "1" apart, so no row leaves the JVM and no answer, however odd, ends the job.
    """
    text = F.col("_text")
    at = lambda v, name: F.try_variant_get(v, f"$['{name}']", "variant")
    out = answers.withColumn("_text", extracted(F.col(raw)))
    out = out.withColumns({"_v": parsed_object(text), "_top": F.json_object_keys(text), "_inner": F.json_object_keys(F.get_json_object(text, f"$['{scores}']"))})
    v, given = F.col("_v"), at(F.col("_v"), scores)
    notes = F.transform(F.try_variant_get(at(v, "evidence_notes"), "$", "array<string>"), lambda n: squeezed(F.coalesce(n, F.lit(""))))
    said = {n: _whole(at(given, n)) for n in RAW_SCORES}
    said |= {"critical_fail": F.try_variant_get(at(v, "critical_fail"), "$", "boolean"), "error_type": F.try_variant_get(at(v, "error_type"), "$", "string"), "reason": squeezed(F.try_variant_get(at(v, "reason"), "$", "string")), "confidence": _confidence(at(v, "confidence")), "evidence_notes": F.slice(F.filter(notes, lambda n: n != ""), 1, 8)}
    kinds = {f"_kind_{n}": _kind(at(v, n)) for n in ("critical_fail", "reason", "evidence_notes")} | {"_kind_scores": _kind(given)}
    out = out.withColumns({f"_{n}": c for n, c in said.items()} | kinds)

    def listed(title: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{title}: "), F.array_join(names, ", ")))

    top, inner = F.col("_top"), F.coalesce("_inner", F.array().cast("array<string>"))
    wanted, wanted_scores = (F.array(*[F.lit(n) for n in names]) for names in ((scores, *FIELDS), tuple(RAW_SCORES)))
    fault = F.coalesce(
        F.when(v.isNull(), F.when(F.size(F.array_distinct(top)) < F.size(top), "repeated fields").otherwise("no JSON object")),
        F.when(~F.col("_kind_scores").startswith("OBJECT"), "no object of scores"),
        listed("missing fields", F.array_except(wanted, top)), listed("unexpected fields", F.array_except(top, wanted)), listed("missing scores", F.array_except(wanted_scores, inner)), listed("unexpected scores", F.array_except(inner, wanted_scores)),
        *[F.when(~F.coalesce(F.col(f"_{n}").isin(*ok), F.lit(False)), f"{n} is not one of {', '.join(map(str, ok))}") for n, ok in RAW_SCORES.items()],
        F.when(F.col("_kind_critical_fail") != "BOOLEAN", "critical_fail is not boolean"),
        F.when(~names_error_type(F.col("_error_type")), "unknown error type"),
        F.when((F.col("_kind_reason") != "STRING") | (F.coalesce("_reason", F.lit("")) == ""), "no reason"),
        F.when(~F.col("_kind_evidence_notes").startswith("ARRAY"), "notes are no list"),
    )
    # what a generator gives is computed below any filter on it: else a filter on the fault would hold all of the above, and one on the raw answer all that it is made of, inlined many times over
    kept = [c for c in answers.columns if c not in ("invalid", *said)]
    out = out.select(*[c for c in kept if c != raw], *[f"_{n}" for n in said], F.explode(F.array(F.struct(fault.alias("invalid"), F.col(raw).alias("raw")))).alias("_fault"))
    invalid = F.col("_fault")["invalid"]
    good = [F.when(invalid.isNull(), error_type(F.col("_error_type")) if n == "error_type" else F.col(f"_{n}")).alias(n) for n in said]
    return out.select(*[F.col("_fault")["raw"].alias(raw) if c == raw else c for c in kept], invalid.alias("invalid"), *good)


def nac_defaults_full(question_type: Column, gold: Column, required: Column, answer: Column) -> Column:
    """Whether numerical accuracy is full because neither case nor answer has a number or code (P18); not for blank answers and numeric cases."""
    kind = F.coalesce(question_type, F.lit(""))
    numeric = kind == NUMERIC_TYPE
    for mark in NUMERIC_MARKS:
        numeric = numeric | F.lower(kind).contains(mark)
    text = F.coalesce(answer, F.lit(""))
    asked = F.size(numbers(gold)) + F.aggregate(F.coalesce(required, F.array().cast("array<string>")), F.lit(0), lambda n, c: n + F.size(numbers(c)))
    return (squeezed(text) != "") & ~numeric & (asked == 0) & (F.size(numbers(text)) == 0)


def item_verdicts(items: DataFrame) -> DataFrame:
    """Verdicts from items that hold raw whole numbers or metrics as text.

    ``items`` has accuracy, completeness, numerical_accuracy and hallucination (preferred where any
    is there), acc, com, nac and hal_pass as text (percent above 1), applicable_metrics as a comma list
    and critical_fail as text. ``invalid`` names an applicable metric without a value; such items
    have no overall score. Without a list the metrics of the raw scores apply, or those present, or all.
    """
    raw = F.coalesce("accuracy", "completeness", "numerical_accuracy", "hallucination").isNotNull()
    from_raw = raw_metrics(*(F.col(n) for n in RAW_SCORES))
    out = items.withColumns({f"_{m}": F.when(raw, from_raw[m]).otherwise(score01(F.col(m))) for m in METRICS})
    listed = F.filter(F.transform(F.split(F.coalesce("applicable_metrics", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.isin(*METRICS))
    of_raw = F.array_compact(F.array(F.lit("acc"), F.when(F.col("completeness") >= 0, "com"), F.when(F.col("numerical_accuracy") >= 0, "nac"), F.lit("hal_pass")))
    present = F.array_compact(F.array(*[F.when(F.col(f"_{m}").isNotNull(), m) for m in METRICS]))
    every = F.array(*[F.lit(m) for m in METRICS])
    applies = F.when(F.size(listed) > 0, listed).when(raw, of_raw).when(F.size(present) > 0, present).otherwise(every)
    out = out.withColumn("applicable", F.array_distinct(applies))
    lacks = F.array_compact(F.array(*[F.when(F.array_contains("applicable", m) & F.col(f"_{m}").isNull(), m) for m in METRICS]))
    out = out.withColumns({"invalid": F.when(F.size(lacks) > 0, F.concat(F.lit("no value: "), F.array_join(lacks, ", "))), **{m: F.when(F.array_contains("applicable", m), F.col(f"_{m}")) for m in METRICS}})
    out = out.withColumn("critical_fail", F.coalesce(parse_bool(F.col("critical_fail")), F.lit(False)))
    out = out.withColumn("overall", F.when(F.col("invalid").isNull(), applicable_mean(*(F.col(m) for m in METRICS))))
    return out.withColumn("pass", passes(F.col("overall"), F.col("critical_fail"))).withColumn("applicable_metrics", F.array_join("applicable", ",")).drop("applicable", *[f"_{m}" for m in METRICS])


def responses(good: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The raw responses of all judges that answered with any text, good ones and failures.

    Without ``failed`` the rows of ``good`` are both, each with its own status. What comes from one
    ``checked`` is so read and checked once, not once for each kind.
    """
    cols = (*KEY, "judge_id", "status", "reason", "raw")
    both = good if failed is None else good.withColumn("status", F.lit("ok")).select(*cols).unionByName(failed.select(*cols))
    told = (F.coalesce("judge_id", F.lit("")) != "") & (F.coalesce("raw", F.lit("")) != "")
    return both.where(told).select(*KEY, "judge_id", F.coalesce("status", F.lit("error")).alias("status"), "reason", "raw", F.substring("raw", 1, 700).alias("excerpt"))


def failures(failed: DataFrame) -> DataFrame:
    """A row for each failed call of a named judge, with or without a response."""
    return failed.where(F.coalesce("judge_id", F.lit("")) != "").withColumn("status", F.coalesce("status", F.lit("error")))
