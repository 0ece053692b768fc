"""Text that a model wrote: clean-up, extraction, and validators that compare it with what it was made from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.similarity import overlap
from folioscope.functions.text import codes, compact, count_lines, count_paragraphs, fold, let, letter_set, numbers, proper_names, text_or_empty

PREAMBLE = r"(?iu)^\s*(?:sure|certainly|of course|here(?:'s| is)|aqui está|claro|segue|voici|bien sûr|por supuesto|aquí está)\b[^\n]{0,120}[:!.]\s*\n*"
LABEL = r"(?iu)^\s*(?:translation|tradução|traducción|traduction|answer|resposta|respuesta|réponse)\s*:\s*"


def clean_output(c: Column) -> Column:
    """Without reasoning tags, code fences, preambles and labels."""
    t = F.regexp_replace(text_or_empty(c), r"(?is)<(think|thinking|reasoning)>.*?(?:</\1>|$)", "")
    t = F.regexp_replace(t, r"(?m)^\s*```\w*\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), PREAMBLE, ""), LABEL, ""))


def has_thinking(c: Column) -> Column:
    return text_or_empty(c).rlike(r"(?i)</?(?:think|thinking|reasoning)>")


def has_preamble(c: Column) -> Column:
    return text_or_empty(c).rlike(PREAMBLE) | text_or_empty(c).rlike(LABEL)


def json_object(c: Column) -> Column:
    """The outermost braces of a text that parse as JSON, as text; null if none."""
    found = F.regexp_extract(text_or_empty(c), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def quoted_options(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(c), F.lit("[\"“'‘]([^\"”'’“‘]{1,80})[\"”'’]"), 1), lambda x: compact(x)))


def alternatives(c: Column) -> Column:
    """Options that exclude each other in a recommendation, split at ``or`` words and slashes."""
    quoted = quoted_options(c)
    parts = F.filter(F.transform(F.split(text_or_empty(c), r"(?iu)\s*(?:/|\bor\b|\bou\b|\bo\b)\s*"), lambda x: compact(x)), lambda x: x != "")
    return F.when(F.size(quoted) > 1, quoted).otherwise(F.array_distinct(parts))


def by_dictionary(c: Column, pairs: dict[str, str]) -> Column:
    """Whole-word replacement by a small dictionary, such as gendered forms."""
    for a, b in sorted(pairs.items(), key=lambda p: -len(p[0])):
        c = F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])\Q{a}\E(?![\p{{L}}\p{{N}}])", b)
    return c


def missing_names(source: Column, output: Column) -> Column:
    return let(fold(output), lambda t: F.filter(proper_names(source), lambda n: ~F.contains(t, fold(n))))


def many_names_missing(source: Column, output: Column, least: int = 3, share: float = 0.2) -> Column:
    gone = F.size(missing_names(source, output))
    return (gone >= least) | (gone > share * F.size(proper_names(source)))


def residual_terms(c: Column, terms: list[str], allowed: list[str] | None = None) -> Column:
    """Given terms left in a text after the allowed ones are taken out."""
    t = reduce(lambda x, a: F.replace(x, F.lit(a.lower()), F.lit(" ")), allowed or [], F.lower(text_or_empty(c)))
    words = F.regexp_extract_all(t, F.lit(r"[\p{L}']+"), 0)
    return F.array_intersect(F.array(*map(F.lit, terms)), words)


def changed_codes(source: Column, output: Column) -> Column:
    return F.struct(F.array_except(codes(source), codes(output)).alias("lost"), F.array_except(codes(output), codes(source)).alias("added"))


def token_report(source: Column, output: Column) -> Column:
    """Names and numbers that went missing or came in between source and output."""
    return F.struct(
        F.array_except(proper_names(source), proper_names(output)).alias("names_lost"), F.array_except(proper_names(output), proper_names(source)).alias("names_added"),
        F.array_except(numbers(source), numbers(output)).alias("numbers_lost"), F.array_except(numbers(output), numbers(source)).alias("numbers_added"),
    )


def output_problems(source: Column, output: Column, residual: list[str] | None = None, low: float = 0.45, high: float = 2.2) -> Column:
    """Array of ``struct<code, severity>`` of what is wrong with an output."""
    a, b = F.length(compact(source)), F.length(compact(output))
    left = F.size(residual_terms(output, residual)) if residual else F.lit(0)
    checks = [
        ((b == 0) & (a > 0), "empty_output", "critical"), (has_thinking(output), "thinking_leak", "critical"), (has_preamble(output), "assistant_preamble", "warning"),
        ((b > 0) & (a >= 40) & (b < low * a), "too_short", "critical"), ((a >= 40) & (b > high * a), "too_long", "warning"),
        ((count_paragraphs(source) > 1) & (count_paragraphs(output) < 0.5 * count_paragraphs(source)), "paragraphs_lost", "warning"),
        ((count_lines(source) > 3) & (count_lines(output) < 0.5 * count_lines(source)), "lines_lost", "warning"),
        ((b > 0) & many_names_missing(source, output), "names_lost", "warning"), ((b > 0) & (F.size(changed_codes(source, output)["lost"]) > 0), "codes_changed", "critical"),
        (left > 5, "residual_language", "critical"), ((left > 0) & (left <= 5), "some_residual_language", "warning"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("code"), F.lit(s).alias("severity"))) for c, n, s in checks)))


def worst(problems: Column) -> Column:
    return F.when(F.exists(problems, lambda p: p["severity"] == "critical"), "critical").when(F.size(problems) > 0, "warning").otherwise("ok")


def invalid_revision(before: Column, after: Column, low: float = 0.75, high: float = 1.9) -> Column:
    """A second pass that shrank, grew, lost names or talks like an assistant."""
    r = F.length(compact(after)) / F.greatest(F.length(compact(before)), F.lit(1))
    return (r < low) | (r > high) | many_names_missing(before, after) | has_preamble(after) | has_thinking(after)


def suggestion_verdict(before: Column, after: Column, confidence: Column, patch: bool = False) -> Column:
    """``struct<accepted, reason>`` of a suggested correction; the first rule that fails is the reason."""
    low, high = (0.35, 2.5) if patch else (0.45, 1.8)
    r = F.length(compact(after)) / F.greatest(F.length(compact(before)), F.lit(1))
    reason = (
        F.when(F.coalesce(compact(after), F.lit("")) == "", "empty").when(F.coalesce(confidence, F.lit(0.0)) < 0.65, "low_confidence")
        .when((r < low) | (r > high), "length").when(F.size(F.array_except(numbers(before), numbers(after))) > 0, "numbers_changed")
        .when(F.size(F.array_except(proper_names(before), proper_names(after))) > 0, "names_changed").when(overlap(letter_set(before), letter_set(after)) < 0.58, "rewritten")
    )
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"))
