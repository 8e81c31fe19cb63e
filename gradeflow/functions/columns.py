"""Parsers and small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS_THRESHOLD = 0.6
CONFLICT_GAP = 0.3
METRICS = ("acc", "com", "nac", "hal_pass")

# The error types and the other names that verdicts use for them.
ERROR_TYPES = ("normal", "partial_inaccuracy", "unsupported_claim", "missing_condition", "format_violation", "unsafe_completion", "hallucinated_policy", "behavior_violation", "ungrounded_answer", "evidence_context_echo", "unscored_case", "provider_error", "llm_judge_error")
OTHER_NAMES = {
    "partial_inaccuracy": ("부분적 부정확", "부분적 부정확성", "부분 부정확성", "부분적 오류", "부분적 불일치", "partial_match", "partial_mismatch", "minor_mismatch", "inaccuracy", "incorrect", "incorrect_answer", "incorrect_content", "incorrect_claim", "incorrect_numeric", "incorrect_information", "inaccurate_content", "information_inaccuracy", "numeric_inaccuracy", "numeric_accuracy", "numeric_miscalculation", "misinterpretation", "typo"),
    "missing_condition": ("incomplete", "partial_completeness", "incomplete_information", "partial_information_missing", "text_incompleteness", "missing_required_steps", "필수 조건 누락", "필수조건 누락", "missing_core_remedy", "missing_required_procedure"),
    "unsupported_claim": ("unsupported_answer", "근거 없는 주장", "근거없는 주장", "unsupported_factual_claim", "unsupported_addition", "unsupported_vague_answer", "unsupported_helpfulness", "partial_hallucination", "material_omission_and_hallucination", "excessive_details", "wrong_source_answer", "incorrect_retrieval_utilization", "ungrounded_answer", "evidence_context_echo", "근거 부족 답변", "근거 원문 반복"),
    "llm_judge_error": ("llm_judge", "judge 오류", "Judge 오류"),
    "format_violation": ("형식 위반",),
    "unsafe_completion": ("위험 응답",),
    "hallucinated_policy": ("정책 환각",),
    "behavior_violation": ("기대 동작 위반",),
    "unscored_case": ("채점 제외 케이스",),
    "provider_error": ("모델 호출 오류",),
}

#: Runs of white space as Unicode and Python know it, with the four separators that Java leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The same, but for single spaces, which need no change: most texts have hardly any other.
UNEVEN_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
TRUE_TEXT = ("1", "true", "yes", "y", "on")
FALSE_TEXT = ("0", "false", "no", "n", "off")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squeezed(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, UNEVEN_SPACE, " "))


def match_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), SPACE, ""))


def parse_bool(c: Column, true: tuple = TRUE_TEXT, false: tuple = FALSE_TEXT) -> Column:
    """true, false or null for anything else."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*true), True).when(t.isin(*false), False)


def score01(c: Column) -> Column:
    """A number as a score from 0 to 1, null if it is none; values above 1 count as percent (M4)."""
    x = c.try_cast("double")
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x)))
    return F.when(x.isNotNull() & ~F.isnan(x), part)


def _compact(c: Column) -> Column:
    """Lower case, runs of white space and hyphens as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[\s-]+", "_"), "^_+|_+$", "")


def _held(names: dict[str, str]) -> Column:
    # a constant map, so that the expression stays small wherever it is inlined
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def _error_type(c: Column) -> Column:
    """The error type that a text names, in its own or its compact form; null for other texts."""
    t = squeezed(c)
    by_name = {n: target for target, others in OTHER_NAMES.items() for n in others}
    return F.coalesce(F.try_element_at(_held(by_name), t), F.try_element_at(_held({n: n for n in ERROR_TYPES} | by_name), _compact(t)))


def error_type(c: Column) -> Column:
    """One of ``ERROR_TYPES``; blank is normal, unknown text a partial inaccuracy (P13). Other names count in their compact form too."""
    c = F.coalesce(c, F.lit(""))
    return F.when(squeezed(c) == "", "normal").otherwise(F.coalesce(_error_type(c), F.lit("partial_inaccuracy")))


def names_error_type(c: Column) -> Column:
    """Whether a text names an error type; blank, null and other values do not."""
    return _error_type(F.coalesce(c, F.lit(""))).isNotNull()


def raw_metrics(accuracy: Column, completeness: Column, numerical: Column, hallucination: Column) -> dict[str, Column]:
    """Raw judge integers as metrics from 0 to 1, null where they do not apply."""
    return {"acc": accuracy / 2, "com": F.when(completeness >= 0, completeness / 2), "nac": F.when(numerical >= 0, numerical.cast("double")), "hal_pass": (1 - hallucination).cast("double")}


def applicable_mean(*metrics: Column) -> Column:
    """Mean of the metrics that apply; null if none does (M1)."""
    count = sum((m.isNotNull().cast("int") for m in metrics), F.lit(0))
    total = sum((F.coalesce(m, F.lit(0.0)) for m in metrics), F.lit(0.0))
    return F.try_divide(total, count)


def passes(overall: Column, critical: Column) -> Column:
    return (overall >= PASS_THRESHOLD) & ~F.coalesce(critical, F.lit(False))


def content_hash(c: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def canonical_json(c: Column) -> Column:
    """JSON text with the names sorted at every level and no white space, however it was written (P45); null for what is no JSON.

    Names sort by UTF-16 units; numbers lose zeros at the end of their fractions, so 1.0 is 1. For a struct,
    map or list give ``to_json(c, {"ignoreNullFields": "false"})``.
    """
    return F.to_json(F.try_parse_json(c))


def json_fingerprint(c: Column, digits: int = 24) -> Column:
    """The hash of JSON text in canonical form: equal for any order of names at any depth."""
    return content_hash(canonical_json(c), digits)


def json_leaves(c: Column) -> Column:
    """The values of JSON text that are no objects or lists, as text, in the order in which they stand, at any depth (2.8).

    Names, nulls, false and zero leave nothing, true is ``True``. Null for what is no JSON. Linear in the text: escaped
    backslashes and quotes are set aside, so that every string is what stands between two quotes.
    """
    aside = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.filter(F.regexp_extract_all(aside, F.lit(r'"[^"]*"\s*:?|-?[0-9][0-9.eE+-]*|true|false|null'), 0), lambda t: ~t.endswith(":"))
    back = lambda t: F.replace(F.replace(t, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))

    def told(t: Column) -> Column:
        text = F.trim(t)
        return F.when(text.startswith('"'), F.try_variant_get(F.try_parse_json(back(text)), "$", "string")).when(text == "true", "True").when(~text.isin("false", "null") & ~text.rlike(r"^-?0+(\.0*)?([eE].*)?$"), text)

    return F.when(F.try_parse_json(c).isNotNull(), F.filter(F.transform(tokens, told), lambda t: F.coalesce(t, F.lit("")) != ""))


def json_as_text(c: Column) -> Column:
    """What a JSON value says: its leaves with single spaces between and within (2.8)."""
    return squeezed(F.array_join(json_leaves(c), " "))
