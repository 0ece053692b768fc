"""Window operators: neighbours, first and last of a key, gaps, caps, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_context(df: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """Text before and after each row."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("previous", F.lag(text).over(w)).withColumn("next", F.lead(text).over(w))


def without_repeats_in_a_row(df: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """Rows that differ from the one before (for equality, the same as differing from the last one kept)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_before", F.lag(text).over(w)).where(~F.col(text).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, key, [F.desc(c) for c in order])


def short_then_long(df: DataFrame, key: list[str], order: list[str], text: str, short: int = 40, long: int = 400) -> DataFrame:
    """A short line followed by a very long one, the first of each short line."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("next_length", F.lead(F.length(text)).over(w)).where((F.length(text) <= short) & (F.length(text) > 0) & (F.col("next_length") >= long))
    return keep_first(rows, [*key, text], order)


def after_mention(df: DataFrame, key: list[str], order: list[str], mention: Column, marker: Column) -> DataFrame:
    """Rows with a marker whose previous row has a mention."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_m", F.lag(mention).over(w)).where(F.coalesce("_m", F.lit(False)) & marker).drop("_m")


def sequence_problems(df: DataFrame, key: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose number repeats, falls behind or leaves a gap after the row before: ``problem``."""
    w = Window.partitionBy(*key).orderBy(*order)
    n, p = F.col(number), F.col("previous_number")
    problem = F.when(n == p, "duplicate").when(n < p, "out_of_order").when(n > p + 1, "gap")
    return df.where(n.isNotNull()).withColumn("previous_number", F.lag(number).over(w)).withColumn("problem", problem).where("problem IS NOT NULL")


def range_problems(df: DataFrame, key: list[str], name: str, first: str, last: str) -> DataFrame:
    """Gaps and overlaps between consecutive ranges: ``kind, from_number, to_number``."""
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last(first), name)
    rows = df.withColumn("previous", F.lag(name).over(w)).withColumn("previous_last", F.lag(last).over(w))
    f, p = F.col(first), F.col("previous_last")
    kind = F.when(f > p + 1, "gap").when(f <= p, "overlap")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select(*key, "previous", name, "kind", F.when(F.col("kind") == "gap", p + 1).otherwise(f).alias("from_number"), F.when(F.col("kind") == "gap", f - 1).otherwise(F.least(F.col(last), p)).alias("to_number"))


def nearby_duplicates(df: DataFrame, key: list[str], section: str, title: str, reach: int = 1) -> DataFrame:
    """Rows of one number whose next row lies within ``reach`` sections: title that was set twice."""
    w = Window.partitionBy(*key).orderBy(section, title)
    rows = df.withColumn("next_section", F.lead(section).over(w)).withColumn("next_title", F.lead(title).over(w))
    return rows.where((F.col("next_section") - F.col(section)) <= reach)


def occurrence_numbers(df: DataFrame, context: list[str], term: Column, order: list) -> DataFrame:
    """Number of each occurrence of a term in its context, and how many there are."""
    w = Window.partitionBy(*context, "_term")
    return df.withColumn("_term", F.lower(term)).withColumn("occurrence", F.row_number().over(w.orderBy(*order))).withColumn("occurrences", F.count("*").over(w)).drop("_term")


def with_ids(df: DataFrame, prefix: str, key: list[str], order: list) -> DataFrame:
    """Sequential ids such as ``cand-0001`` within a document, over an explicit total order."""
    return df.withColumn("id", F.format_string(f"{prefix}-%04d", F.row_number().over(Window.partitionBy(*key).orderBy(*order))))


def capped(df: DataFrame, key: list[str], kind: str, order: list, per_kind: int = 30, total: int = 120) -> DataFrame:
    """The report's rows of each document: at most ``per_kind`` of a kind, then at most ``total``, both in reading order."""
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(*key, kind).orderBy(*order))).where(F.col("_k") <= per_kind)
    return first.withColumn("_t", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_t") <= total).drop("_k", "_t")
