"""Aggregations: vocabularies, ratios, roll-ups, sequences, collisions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import clean_for_comparison, proper_names, tokens


def word_frequency(df: DataFrame, text: str, key: list[str] | None = None) -> DataFrame:
    words = df.select(*(key or []), F.explode(tokens(F.lower(text))).alias("token"))
    return words.groupBy(*(key or []), "token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, text: str, stopwords: list[str], least_length: int = 4, low: int = 2, high: int = 80) -> DataFrame:
    """Words of a length whose number lies within bounds: neither noise nor common."""
    n = word_frequency(df, text)
    return n.where((F.length("token") >= least_length) & ~F.col("token").isin(stopwords) & F.col("n").between(low, high))


def named_entities(df: DataFrame, key: list[str], text: str, order: str, least: int = 2, examples: int = 8) -> DataFrame:
    """Names that occur in enough rows, with their first rows as examples."""
    names = df.select(*key, order, F.explode(proper_names(F.col(text))).alias("name"))
    counted = names.groupBy(*key, "name", order).agg(F.count("*").alias("_n"))  # a row's repeats are one example
    w = Window.partitionBy(*key, "name").orderBy(order)
    ranked = counted.withColumn("_r", F.row_number().over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.col(order))))
    return ranked.groupBy(*key, "name").agg(F.sum("_n").alias("n"), shown.alias("examples")).where(F.col("n") >= least)


def repetition(df: DataFrame, key: list[str], text: str, least: int = 20, warn: float = 0.05, fail: float = 0.15) -> DataFrame:
    """Share of a text's sentences that occur more than once, and the verdict."""
    pieces = df.select(*key, F.explode(F.split(text, r"[.!?;:\n]+")).alias("_p")).where(F.length(F.trim("_p")) > least)
    counted = pieces.groupBy(*key, clean_for_comparison(F.col("_p")).alias("_line")).agg(F.count("*").alias("_n"))
    many = F.coalesce(F.sum(F.when((F.col("_n") > 1) & (F.length("_line") > least), F.col("_n"))), F.lit(0))
    out = counted.groupBy(*key).agg(F.sum("_n").alias("pieces"), many.alias("repeated"))
    share = F.col("repeated") / F.col("pieces")
    return out.withColumn("ratio", F.round(share, 3)).withColumn("verdict", F.when(share > fail, "FAIL").when(share > warn, "WARN").otherwise("OK"))


def ratio_checks(pairs: DataFrame, source: str, target: str, fail: float, warn: float, long: float, least: int = 0) -> DataFrame:
    """``ratio`` of two sizes and its verdict: too short (FAIL or WARN) or too long (WARN)."""
    ratio = F.col(target) / F.greatest(F.col(source), F.lit(1))
    judged = F.when(F.col(source) < least, None).when(ratio < fail, "FAIL").when((ratio < warn) | (ratio > long), "WARN")
    return pairs.withColumn("ratio", F.round(ratio, 3)).withColumn("verdict", judged)


def structural_score(df: DataFrame, key: list[str], missing: Column, very_short: Column, short: Column) -> DataFrame:
    """1 - 0.15 a missing section - 0.1 or 0.05 a short one, within 0 and 1."""
    lost = F.sum(F.when(missing, 0.15).when(very_short, 0.1).when(short, 0.05).otherwise(0.0))
    return df.groupBy(*key).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lost)), 6).alias("score"))


def run_summary(findings: DataFrame, key: list[str]) -> DataFrame:
    """Findings by severity, types as a map, and the status: FAIL, WARN or OK."""
    by = findings.groupBy(*key, "type", "severity").agg(F.count("*").alias("n"))
    s = lambda x: F.coalesce(F.sum(F.when(F.col("severity") == x, F.col("n"))), F.lit(0))
    out = by.groupBy(*key).agg(F.sum("n").alias("total"), s("FAIL").alias("fail"), s("WARN").alias("warn"), s("INFO").alias("info"), F.count_distinct("type").alias("types"))
    return out.withColumn("status", F.when(F.col("fail") > 0, "FAIL").when(F.col("warn") > 0, "WARN").otherwise("OK"))


def pivot_counts(df: DataFrame, key: list[str], column: str, values: list[str]) -> DataFrame:
    """Rows by status as columns; a pivot with given values needs no pass to find them."""
    return df.groupBy(*key).pivot(column, values).count().na.fill(0, values)


def by_category(findings: DataFrame, categories: DataFrame, default: str, column: str = "category", examples: int = 12) -> DataFrame:
    """Findings by fixed categories, empty ones included; unknown ones fall to ``default``."""
    known = findings.join(categories.select(F.col(column), F.lit(True).alias("_k")), column, "left")
    known = known.withColumn(column, F.when(F.col("_k"), F.col(column)).otherwise(default))
    each = known.groupBy(column, "detail").agg(F.count("*").alias("_n"))
    n = _first_of(each, [column], "detail", examples).groupBy(column).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list("_shown")).alias("examples"))
    return categories.join(n, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merge_changes(changes: DataFrame, key: list[str]) -> DataFrame:
    return changes.groupBy(*key).agg(F.sum("count").alias("count"))


def alias_roll_up(changes: DataFrame, most: int = 5) -> DataFrame:
    """Changes by canonical name and alias with a few examples."""
    each = changes.groupBy("canonical", "alias", "example").agg(F.sum("count").alias("count"))
    return _first_of(each, ["canonical", "alias"], "example", most).groupBy("canonical", "alias").agg(F.sum("count").alias("count"), F.array_sort(F.collect_list("_shown")).alias("examples"))


def _first_of(df: DataFrame, key: list[str], value: str, most: int) -> DataFrame:
    """Rows with ``_shown``: the value of the first ``most`` rows of each key, null for the others, so lists stay short."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last(value)))
    return df.withColumn("_shown", F.when(n <= most, F.col(value)))


def roll_up(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """Sums by key and over all (key null)."""
    return df.rollup(key).agg(*[F.sum(c).alias(c) for c in sums])


def covered_twice(ranges: DataFrame, key: list[str], name: str, first: str, last: str) -> DataFrame:
    """Numbers that more than one range covers, with the ranges."""
    each = ranges.where(F.col(first) <= F.col(last)).select(*key, name, F.explode(F.sequence(first, last)).alias("number"))
    return each.groupBy(*key, "number").agg(F.array_sort(F.collect_set(name)).alias("names"), F.count_distinct(name).alias("n")).where("n > 1")


def metadata_differences(df: DataFrame, key: list[str], fields: list[str], nulls_count: bool = True) -> DataFrame:
    """Fields with more than one value: ``field, values``; a null is a value of its own or is not counted."""
    long = df.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(*key, "x.*")
    long = long.withColumn("value", F.coalesce("value", F.lit("(none)"))) if nulls_count else long.where("value IS NOT NULL")
    return long.groupBy(*key, "field").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def collisions(df: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys with several rows: duplicates (one content) or collisions (different contents)."""
    n = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("contents")).where("n > 1")
    return n.withColumn("type", F.when(F.col("contents") > 1, "samePathDifferentHash").otherwise("samePathSameHash"))


def missing_numbers(df: DataFrame, key: list[str], number: str) -> DataFrame:
    """Numbers absent between each key's least and greatest: one row a gap, by neighbours, never a list of all numbers."""
    distinct = df.where(F.col(number).isNotNull()).select(*key, number).distinct()
    w = Window.partitionBy(*key).orderBy(number)
    gaps = distinct.withColumn("_next", F.lead(number).over(w)).where(F.col("_next") > F.col(number) + 1)
    return gaps.select(*key, (F.col(number) + 1).alias("from_number"), (F.col("_next") - 1).alias("to_number"))


def duplicate_numbers(df: DataFrame, key: list[str], number: str) -> DataFrame:
    return df.where(F.col(number).isNotNull()).groupBy(*key, number).agg(F.count("*").alias("n")).where("n > 1")


def confidence_summary(df: DataFrame, key: list[str], confidence: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.min(confidence).alias("least"), F.round(F.avg(confidence), 6).alias("mean"), F.max(confidence).alias("most"))


def source_score(df: DataFrame) -> DataFrame:
    """Worth of a chapter source: coverage first, then size and priority, less its conflicts."""
    bad = F.col("conflicts") + F.col("duplicates") + F.col("out_of_order")
    return df.withColumn("score", F.round(1000 * F.col("coverage"), 3) + F.least(F.col("chapters"), F.lit(999)) + 10 * F.col("priority") - 100 * bad)


def compare_runs(before: DataFrame, after: DataFrame, key: list[str], count: str) -> DataFrame:
    """Full outer comparison of two runs by key: counts before and after, difference, direction."""
    a = before.groupBy(*key).agg(F.sum(count).alias("before"))
    b = after.groupBy(*key).agg(F.sum(count).alias("after"))
    both = a.join(b, key, "full_outer").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
    return both.withColumn("direction", F.when(F.col("delta") < 0, "better").when(F.col("delta") > 0, "worse").otherwise("same"))


def reading_scores(df: DataFrame, high: Column, medium: Column, low: Column) -> DataFrame:
    """Health out of 10 from findings, and its label."""
    lost = (2 * high + medium + 0.5 * low) / 10
    health = F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - lost)), 1)
    return df.withColumn("health", health).withColumn("label", F.when(health >= 8.5, "good").when(health >= 6.5, "attention").otherwise("problem"))


def word_language(df: DataFrame, key: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """Language by marker words: (common + 2 strong) / words, for each language; ``lexicon``: token, lang, strong."""
    words = df.select(*key, F.explode(tokens(F.lower(text))).alias("token"))
    total = words.groupBy(*key).agg(F.count("*").alias("words"))
    hits = words.join(lexicon, "token").groupBy(*key, "lang").agg(F.sum(F.when(F.col("strong"), 2).otherwise(1)).alias("weight"))
    return hits.join(total, key).withColumn("score", F.round(F.col("weight") / F.col("words"), 6))


def dominant(scores: DataFrame, key: list[str]) -> DataFrame:
    """The language with the best score (of equal ones the first by name)."""
    best = F.max(F.struct("score", F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba").alias("_o"), "lang"))
    return scores.groupBy(*key).agg(best.alias("_b")).select(*key, F.col("_b.lang").alias("lang"), F.col("_b.score").alias("score"))


def residual_ratio(df: DataFrame, key: list[str], text: str, lexicon: DataFrame, distinct: bool = False, fail: float = 0.15, warn: float = 0.05) -> DataFrame:
    """Share of words of another language; ``distinct`` counts each of them once (over all words)."""
    words = df.select(*key, F.explode(F.split(F.lower(text), r"\s+")).alias("_w")).withColumn("token", F.regexp_replace("_w", r"[^\p{L}]", "")).where("_w != ''")
    total = words.groupBy(*key).agg(F.count("*").alias("words"))
    hit = words.join(lexicon.select("token").distinct(), "token")
    n = hit.groupBy(*key).agg((F.count_distinct("token") if distinct else F.count("*")).alias("hits"))
    ratio = F.col("hits") / F.col("words")
    return total.join(n, key, "left").na.fill(0, ["hits"]).withColumn("ratio", F.round(ratio, 6)).withColumn("verdict", F.when(ratio > fail, "FAIL").when(ratio > warn, "WARN").otherwise("OK"))


def reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with at least one failed check and the joined names of those."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return df.withColumn("reasons", F.concat_ws("; ", failed)).where("reasons != ''")


def named_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row a named check of a one-row frame, and whether it holds."""
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()))
    return df.select(F.explode(rows).alias("x")).select("x.*")


def against_baseline(actual: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """Approved values against actual ones; a value without counterpart fails."""
    both = baseline.select(key, F.col(value).alias("approved")).join(actual.select(key, F.col(value).alias("actual")), key, "full_outer")
    return both.withColumn("passed", F.col("approved").eqNullSafe(F.col("actual")))


def event_flows(events: DataFrame, key: str, time: str, kind: str, tie: str) -> DataFrame:
    """Each key's events in order of time."""
    ordered = F.array_sort(F.collect_list(F.struct(time, tie, kind)))
    return events.groupBy(key).agg(F.count("*").alias("n"), F.transform(ordered, lambda x: x[kind]).alias("flow"))


def last_run(events: DataFrame, time: str, kind: str, start: str) -> DataFrame:
    """Events of the last run: those at or after the last start."""
    begun = events.where(F.col(kind) == start).agg(F.max(time).alias("_start"))
    return events.join(F.broadcast(begun), F.col(time) >= F.col("_start")).drop("_start")


def common_prefix(df: DataFrame, key: list[str], title: str) -> DataFrame:
    """Longest common beginning of each key's titles: the beginning that least and greatest title share."""
    ends = df.where(F.col(title).isNotNull()).groupBy(*key).agg(F.min(title).alias("a"), F.max(title).alias("b"))
    n = F.expr("size(filter(sequence(1, greatest(least(length(a), length(b)), 1)), i -> left(a, i) = left(b, i)))")
    return ends.select(*key, F.trim(F.substring("a", F.lit(1), n)).alias("prefix"))
