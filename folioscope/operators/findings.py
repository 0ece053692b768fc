"""Findings: one schema, keys, de-duplication, order, caps, groups.

A finding has ``unit`` (what it is about), ``type``, ``severity``, ``occurrences`` and ``detail``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import comparable, let

WEIGHT = {"FAIL": 0, "high": 0, "WARN": 1, "medium": 1, "INFO": 2, "low": 2}


def finding(df: DataFrame, unit: Column, kind: str | Column, severity: str | Column, occurrences: Column | None = None, detail: Column | None = None) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        unit.cast("string").alias("unit"), as_col(kind).alias("type"), as_col(severity).alias("severity"),
        (occurrences if occurrences is not None else F.lit(1)).cast("bigint").alias("occurrences"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in WEIGHT.items() for x in p]), c), F.lit(9))


def stable_key(*parts: Column) -> Column:
    """Parts joined by ``::``; an empty part keeps its place as ``-``."""
    return F.concat_ws("::", *(F.coalesce(F.when(F.trim(p.cast("string")) != "", F.trim(p.cast("string"))), F.lit("-")) for p in parts))


def dedupe_key(*parts: Column) -> Column:
    return stable_key(*(comparable(p.cast("string")) for p in parts))


def dedupe(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first finding of each key; findings without key all stay."""
    keyed = df.withColumn("_key", key)
    first = keyed.where("_key IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_r = 1").drop("_r")
    return first.unionByName(keyed.where("_key IS NULL")).drop("_key")


def dedupe_candidates(df: DataFrame, key: list[str], number: str, title: Column, order: list) -> tuple[DataFrame, DataFrame]:
    """One candidate a number, and the numbers whose candidates have different titles."""
    w = Window.partitionBy(*key, number)
    rows = df.withColumn("_title", title)
    best = rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").drop("_r", "_title")
    conflict = rows.groupBy(*key, number).agg(F.count_distinct("_title").alias("titles")).where("titles > 1")
    return best, conflict


def in_report_order(df: DataFrame, chapter: str = "chapter") -> DataFrame:
    """By chapter (other than numbers last), severity, type and unit."""
    return df.orderBy(F.coalesce(F.col(chapter).try_cast("int"), F.lit(9999)), severity_rank(F.col("severity")), F.lower("type"), "unit")


def top(df: DataFrame, by: list, n: int) -> DataFrame:
    """A report's first rows in a total order."""
    return df.orderBy(*by).limit(n)


def best_source(df: DataFrame, n: int = 1) -> DataFrame:
    return df.orderBy(F.desc("score"), F.desc("priority"), F.desc("chapters"), "source").limit(n)


def distinct_with_ids(df: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Different rows with the ids of all that were equal."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(ident)).alias("ids"), F.count("*").alias("n"))


def content_diff(a: DataFrame, b: DataFrame, key: str, content: str) -> DataFrame:
    """Names added, removed or changed between two packages."""
    x = a.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_a"))
    y = b.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_b"))
    both = x.join(y, key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.withColumn("change", kind).where("change IS NOT NULL").select(key, "change")


def longest_phrases(found: Column) -> Column:
    """Phrases that no longer phrase of the array contains."""
    return F.filter(found, lambda p: ~F.exists(found, lambda q: (F.length(q) > F.length(p)) & F.contains(q, p)))


def missing_items(wanted: Column, text: Column) -> Column:
    return let(comparable(text), lambda t: F.filter(wanted, lambda x: ~F.contains(t, comparable(x))))


def impact(df: DataFrame) -> DataFrame:
    """Impact and next action of a review item."""
    kind = F.when(F.col("severity").isin("FAIL", "high"), "high").when(F.col("severity").isin("WARN", "medium"), "medium").otherwise("low")
    action = F.when(F.col("status") == "approved", "apply").when(F.col("status") == "rejected", "none").when(kind == "high", "review first").otherwise("review")
    return df.withColumn("impact", kind).withColumn("next_action", action)


def report_label(df: DataFrame, key: list[str]) -> DataFrame:
    """OK, ATTENTION or PROBLEM by the worst finding."""
    worst = df.groupBy(*key).agg(F.min(severity_rank(F.col("severity"))).alias("_w"), F.array_sort(F.collect_set("type")).alias("types"))
    return worst.withColumn("label", F.when(F.col("_w") == 0, "PROBLEM").when(F.col("_w") == 1, "ATTENTION").otherwise("OK")).drop("_w")
