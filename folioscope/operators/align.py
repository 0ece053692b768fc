"""Alignment of a source edition with a derived one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.headings import number_of_section
from folioscope.functions.similarity import length_similarity
from folioscope.functions.text import folded, numbers, proper_names, punctuation_profile

#: A paragraph pair is safe from this score on, if it leads the second best by the margin.
SCORE, MARGIN = 0.72, 0.12


def first_per(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order (a plain distinct has none)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def by_position(source: DataFrame, target: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """Full outer join of non-empty sections by rank: ``match_type`` matched, missing or extra, and a confidence."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    side = lambda d, p: d.where(F.col(size) > 0).select(key, rank.alias("rank"), *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != key])
    both = side(source, "source").join(side(target, "target"), [key, "rank"], "full_outer")
    a, b = F.col(f"source_{size}"), F.col(f"target_{size}")
    kind = F.when(b.isNull(), "missing").when(a.isNull(), "extra").otherwise("matched")
    ratio = b / a
    fit = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.least(ratio, 1 / ratio)))
    return both.withColumn("match_type", kind).withColumn("confidence", F.when(kind == "matched", F.round(fit, 6)).otherwise(F.lit(0.0)))


def title_key(title: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(folded(title), r"^(?:capitulo|chapitre)\s+", "chapter "), r"^cap\s+", "chapter "), F.lit(""))


def cascade(source: DataFrame, target: DataFrame, key: str, ident: str, index: str, title: str, path: str) -> DataFrame:
    """Each target section with a source section: by chapter number, else by title, else by index, else none.

    ``target``, ``source`` (ids), ``confidence`` 0.95, 0.9, 0.35 or 0, ``reason``.
    """
    prep = lambda d: d.select(key, F.col(ident).alias("_id"), F.col(index).alias("_index"), number_of_section(F.col(title), F.col(path)).alias("_number"), title_key(F.col(title)).alias("_title"))
    s, t = prep(source), prep(target)
    pick = lambda column, name: first_per(s.where(F.col(column).isNotNull()), [key, column], ["_index", "_id"]).select(key, column, F.col("_id").alias(name))
    out = t.join(pick("_number", "_a"), [key, "_number"], "left").join(pick("_title", "_b"), [key, "_title"], "left").join(pick("_index", "_c"), [key, "_index"], "left")
    conf = F.when(F.col("_a").isNotNull(), 0.95).when(F.col("_b").isNotNull(), 0.9).when(F.col("_c").isNotNull(), 0.35).otherwise(0.0)
    reason = F.when(F.col("_a").isNotNull(), "chapter_number_match").when(F.col("_b").isNotNull(), "normalized_title_match").when(F.col("_c").isNotNull(), "index_fallback_low_confidence").otherwise("no_alignment_candidate")
    return out.select(key, F.col("_id").alias("target"), F.coalesce("_a", "_b", "_c").alias("source"), conf.alias("confidence"), reason.alias("reason"))


def alignment_stats(aligned: DataFrame, key: str) -> DataFrame:
    """Reliable, weak and missing matches of a document, and the severity of what is missing."""
    c = F.col("confidence")
    stats = aligned.groupBy(key).agg(F.count("*").alias("sections"), F.count_if(c >= 0.8).alias("reliable"), F.count_if((c > 0) & (c < 0.8)).alias("weak"), F.count_if(c == 0).alias("unmatched"))
    return stats.withColumn("severity", F.when(F.col("unmatched") > 3, "FAIL").when(F.col("unmatched") > 1, "WARN").otherwise("OK"))


def paragraph_score(source: Column, target: Column) -> Column:
    """Score of a paragraph pair by shared names, numbers, punctuation and length."""
    names = F.size(F.array_intersect(proper_names(source), proper_names(target)))
    shared, a, b = F.size(F.array_intersect(numbers(source), numbers(target))), F.size(numbers(source)), F.size(numbers(target))
    p, q = punctuation_profile(source), punctuation_profile(target)
    same = sum(((p[f] == q[f]).cast("int") for f in ("question", "exclamation", "quote")), F.lit(0))
    length = length_similarity(source, target)
    score = F.when(names >= 2, 0.45).when(names == 1, 0.28).otherwise(0.0) + F.when((shared > 0) & (shared == F.least(a, b)), 0.2).otherwise(0.0) + F.when(same >= 2, 0.12).otherwise(0.0) + F.when(length >= 0.45, 0.18 * length).otherwise(0.0)
    return F.least(score, F.lit(0.99))


def best_with_margin(pairs: DataFrame, target: list[str], source: str, score: str, least: float = SCORE, margin: float = MARGIN) -> DataFrame:
    """The best source of each target if it is good enough and clearly ahead of the second."""
    w = Window.partitionBy(*target).orderBy(F.desc(score), source)
    second = F.coalesce(F.lead(score).over(w), F.lit(0.0))
    best = pairs.withColumn("_r", F.row_number().over(w)).withColumn("margin", F.round(F.col(score) - second, 6)).where("_r = 1").drop("_r")
    return best.withColumn("safe", (F.col(score) >= least) & (F.col("margin") >= margin))


def align_paragraphs(source: DataFrame, target: DataFrame, key: list[str], ident: str, text: str) -> DataFrame:
    """Scored best source paragraph of each target paragraph within a chapter (an equi-join on the chapter)."""
    s = source.select(*key, F.col(ident).alias("source"), F.col(text).alias("_s"))
    t = target.select(*key, F.col(ident).alias("target"), F.col(text).alias("_t"))
    pairs = t.join(s, key).select(*key, "target", "source", F.round(paragraph_score(F.col("_s"), F.col("_t")), 6).alias("score"))
    return best_with_margin(pairs, [*key, "target"], "source", "score")


def assign_greedily(pairs: DataFrame, key: str, left: str, right: str, score: str, least: float = 0.3) -> DataFrame:
    """1:1 assignment inside a document: in source order, each source takes its best free target above ``least``."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (key, left, right)}

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f[score] > least].sort_values([left, score, right], ascending=[True, False, True])
        taken, out = set(), []
        for a, g in f.groupby(left, sort=False):
            for row in g.itertuples(index=False):
                r = getattr(row, right)
                if r not in taken:
                    taken.add(r)
                    out.append((getattr(row, key), a, r, getattr(row, score)))
                    break
        return pd.DataFrame(out, columns=[key, left, right, score])

    return pairs.select(key, left, right, score).groupBy(key).applyInPandas(one, f"`{key}` {kinds[key]}, `{left}` {kinds[left]}, `{right}` {kinds[right]}, `{score}` double")


def pair_files(source: DataFrame, target: DataFrame, key: list[str], name: str, first: str, last: str) -> DataFrame:
    """Files of a group with the same chapter range, the others by position; of several with one range the first by name."""
    side = lambda d, x: d.select(*key, F.col(name).alias(x), F.col(first).alias("_f"), F.col(last).alias("_l"))
    nth = lambda x, *w: F.row_number().over(Window.partitionBy(*key, *w).orderBy(F.asc_nulls_last("_f"), x))
    s, t = side(source, "source"), side(target, "target")
    ranged = s.withColumn("_r", nth("source", "_f", "_l")).join(t.withColumn("_r", nth("target", "_f", "_l")), [*key, "_f", "_l", "_r"]).select(*key, "source", "target", F.lit("range").alias("by"))
    left = lambda d, x: d.join(ranged, [*key, x], "left_anti").withColumn("_n", nth(x)).select(*key, x, "_n")
    rest = left(s, "source").join(left(t, "target"), [*key, "_n"]).select(*key, "source", "target", F.lit("position").alias("by"))
    return ranged.unionByName(rest)


def boundaries(candidates: DataFrame, canonical: DataFrame, key: str, number: str, title: str, confidence: str) -> tuple[DataFrame, DataFrame]:
    """Candidates that fit the canonical chapters (best confidence of each number), and the numbers without one."""
    c = canonical.select(key, number, title_key(F.col(title)).alias("_want"))
    near = candidates.withColumn("_have", title_key(F.col(title))).join(c, [key, number])
    fits = near.where(F.col("_want").isNull() | F.col("_have").isNull() | F.contains("_have", F.col("_want")) | F.contains("_want", F.col("_have")))
    w = Window.partitionBy(key, number)
    ranked = fits.withColumn("ambiguous", F.count("*").over(w) > 1).withColumn("_r", F.row_number().over(w.orderBy(F.desc(confidence), "_have"))).where("_r = 1")
    return ranked.drop("_r", "_have", "_want"), canonical.join(ranked, [key, number], "left_anti")


def to_canonical(chapters: DataFrame, canonical: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Chapters in order with the canonical list's entries in order."""
    a = chapters.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    b = canonical.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(label))).select(key, "_n", F.col(label).alias("canonical"))
    return a.join(b, [key, "_n"], "left").drop("_n")


def leaks(chapters: DataFrame, key: str, number: str, text: str, words: int = 8) -> DataFrame:
    """Chapters whose first or last words are found in the chapter before or after: text that slipped over a boundary."""
    w = Window.partitionBy(key).orderBy(number)
    t = folded(F.col(text))
    parts = F.split(t, " ")
    start = F.array_join(F.slice(parts, 1, words), " ")
    end = F.array_join(F.slice(parts, F.greatest(F.size(parts) - words + 1, F.lit(1)), F.lit(words)), " ")
    rows = chapters.select(key, number, t.alias("_t"), start.alias("_a"), end.alias("_b"), F.size(parts).alias("_n"))
    rows = rows.withColumn("_before", F.lag("_t").over(w)).withColumn("_after", F.lead("_t").over(w))
    return rows.select(key, number, F.coalesce((F.col("_n") >= words) & F.contains("_before", F.col("_a")), F.lit(False)).alias("first_in_previous"), F.coalesce((F.col("_n") >= words) & F.contains("_after", F.col("_b")), F.lit(False)).alias("last_in_next"))


def banded(source: DataFrame, target: DataFrame, key: str, pos: str, score: Column, reach: int = 18) -> DataFrame:
    """Best partner within ``reach`` positions: a band join on buckets, so the work grows with the rows, not with their square."""
    bucket = F.floor(F.col(pos) / reach)
    s = source.withColumn("_b", bucket).withColumnRenamed(pos, "source_pos")
    t = target.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed(pos, "target_pos")
    near = s.join(t, [key, "_b"]).where(F.abs(F.col("source_pos") - F.col("target_pos")) <= reach).withColumn("score", score)
    return first_per(near, [key, "target_pos"], [F.desc("score"), F.abs(F.col("source_pos") - F.col("target_pos")), "source_pos"]).drop("_b")
