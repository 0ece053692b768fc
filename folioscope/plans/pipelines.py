"""Composite plans: whole audits, merge precheck, structure, and correct-and-compare, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.headings import parse_heading
from folioscope.operators import aggregate, correct, detect, findings, match, state, windows

#: Order of the detectors in a semantic report.
RANK = ["repetition_anomaly", "treatment_inconsistency", "terminology_inconsistency", "omission_or_expansion", "number_missing", "entity_drift", "dialogue_punctuation_drift"]


def semantic_audit(pairs: DataFrame, glossary: DataFrame, document: str, order: str, unit: str, source: str, target: str, per_kind: int = 30, total: int = 120) -> DataFrame:
    """All paragraph detectors over aligned pairs, in reading order, with the report's caps and ids."""
    found = findings.union_all(
        detect.repetition_findings(pairs, unit, target), detect.treatment_findings(pairs, unit, target),
        detect.terminology_findings(pairs, glossary, unit, target), detect.pair_findings(pairs, unit, source, target),
    )
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("type"))
    placed = found.join(pairs.select(F.col(unit).cast("string").alias("unit"), document, order).distinct(), "unit").withColumn("rank", rank)
    kept = windows.capped(placed, [document], "type", [order, "unit", "rank"], per_kind, total)
    return windows.with_ids(kept, "sem", [document], [order, "unit", "rank"]).drop("rank")


def comparison_audit(pairs: DataFrame, glossary: DataFrame, resolved: DataFrame, categories: DataFrame, unit: str, source: str, target: str, titles: tuple[str, str] | None = None, phrases: list[str] | None = None, more: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Coverage, title, terminology, residual, boundary and ``more`` (character, meaning) findings: without what is resolved,
    each once, in report order; and by category. ``titles`` are the columns of a title and its expected form."""
    first = lambda c: F.substring_index(F.trim(F.col(c)), "\n", 1)
    opened = pairs.where(F.col(target).isNotNull()).select(unit, first(source).alias("_s"), first(target).alias("_t"))
    found = findings.union_all(
        detect.coverage_findings(pairs, unit, source, target), detect.terminology_findings(pairs.where(F.col(target).isNotNull()), glossary, unit, target),
        detect.boundary_findings(opened, unit, "_s", "_t"),
        *([detect.title_findings(pairs, unit, *titles)] if titles else []), *([detect.foreign_terms(pairs, unit, target, phrases)] if phrases else []), *(more or []),
    )
    keyed = found.withColumn("stable_key", findings.stable_key(F.col("unit"), F.col("type"), F.col("detail"))).withColumn("category", F.col("type"))
    rest = match.unresolved(keyed, resolved, ["stable_key"])
    once = findings.dedupe(rest, findings.dedupe_key(F.col("unit"), F.col("type"), F.col("detail")), [findings.severity_rank(F.col("severity")), "stable_key"])
    return once, aggregate.by_category(once, categories, "editorial")


def merge_precheck(parts: DataFrame, key: str, name: str, first: str, last: str, fields: list[str]) -> DataFrame:
    """Per group of parts: coded problems with their level (errors block, a gap only warns) and the resulting status."""
    coded = lambda d, code, level, detail: d.select(key, F.lit(code).alias("code"), F.lit(level).alias("level"), detail.cast("string").alias("detail"))
    vague = coded(parts.where(F.col(first).isNull() | F.col(last).isNull()), "AMBIGUOUS_RANGE", "error", F.col(name))
    wrong = coded(parts.where(F.col(first) > F.col(last)), "INVALID_RANGE", "error", F.col(name))
    ranged = windows.range_problems(parts.where(F.col(first) <= F.col(last)), [key], name, first, last)
    detail = F.concat_ws("-", "from_number", "to_number")
    gaps, overlaps = coded(ranged.where("kind = 'gap'"), "GAP", "warning", detail), coded(ranged.where("kind = 'overlap'"), "OVERLAP", "error", detail)
    twice = coded(aggregate.covered_twice(parts, [key], name, first, last), "DUPLICATE_CHAPTERS", "error", F.col("number"))
    differ = coded(aggregate.metadata_differences(parts, [key], fields), "METADATA_DIFFERENCE", "warning", F.col("field"))
    problems = findings.union_all(vague, wrong, gaps, overlaps, twice, differ)
    status = F.max(F.when(F.col("level") == "error", 1).otherwise(0)).over(Window.partitionBy(key))
    return problems.withColumn("status", F.when(status == 1, "blocked").otherwise("ready_for_merge"))


def structure(sections: DataFrame, books: DataFrame, book: str, source: str, index: str, title: str, number: str, first: str, last: str) -> DataFrame:
    """Per book and edition: chapters found by heading or number, coverage of the expected range, conflicts, and a score."""
    parsed = parse_heading(F.col(title))
    n = F.coalesce(parsed["number"], F.col(number))
    rows = sections.withColumn("_n", n).withColumn("_c", parsed["confidence"])
    w = Window.partitionBy(book, source).orderBy(index)
    rows = rows.withColumn("_late", F.coalesce(F.col("_n") < F.lag("_n").over(w), F.lit(False)))
    out = rows.groupBy(book, source).agg(F.count("*").alias("sections"), F.count_distinct("_n").alias("chapters"), (F.count("_n") - F.count_distinct("_n")).alias("duplicates"), F.count_if("_late").alias("out_of_order"), F.round(F.avg("_c"), 6).alias("confidence"))
    span = books.groupBy(book).agg(F.max(F.col(last) - F.col(first) + 1).alias("_expected"))
    # Numbers under which titles differ are conflicts.
    titled = rows.where("_n IS NOT NULL").groupBy(book, source, "_n").agg(F.count_distinct(parsed["title"]).alias("_t")).where("_t > 1").groupBy(book, source).agg(F.count("*").alias("conflicts"))
    out = out.join(titled, [book, source], "left").na.fill(0, ["conflicts"])
    out = out.join(span, book, "left").withColumn("coverage", F.least(F.lit(1.0), F.col("chapters") / F.coalesce("_expected", "chapters"))).withColumn("priority", F.when(F.col(source) == "source", 2).otherwise(1))
    return aggregate.source_score(out).drop("_expected", "priority")


def fix_and_compare(texts: DataFrame, unit: str, text: str, rules: correct.Rules, checks: list[detect.Rule]) -> DataFrame:
    """Audit, correct by ordered rules, audit again, and compare findings by type."""
    return state.fix_and_compare(texts, lambda d: d.withColumn(text, correct.apply_rules(F.col(text), rules)), lambda d: detect.by_rules(d, unit, text, checks), ["type"])

