"""Lookups: glossaries in texts, positions in ranges, decisions and states on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import comparable, compact, fold
from folioscope.operators.align import first_per

WORDS = r"[\p{L}\p{N}]+"


def glossary_hits(texts: DataFrame, glossary: DataFrame, ident: list[str], text: str, term: str = "from_text") -> DataFrame:
    """``ident, term, hits``: whole-word occurrences of glossary terms, ignoring case and accents.

    Texts are cut into words once and joined with the glossary on a term's first word, then the words behind it are
    compared; work grows with the words that start a term, not with texts times terms. With each word travel as many
    words behind it as the longest term has, never the whole text.
    """
    words = F.regexp_extract_all(fold(F.col(text)), F.lit(WORDS), 0)
    parts = F.regexp_extract_all(fold(F.col(term)), F.lit(WORDS), 0)
    g = glossary.where(F.trim(F.coalesce(F.col(term), F.lit(""))) != "").select(F.col(term).alias("term"), parts.alias("_parts")).where(F.size("_parts") > 0)
    g = g.withColumn("_first", F.col("_parts")[0]).dropDuplicates(["term"])
    longest = F.coalesce(g.select(F.max(F.size("_parts"))).scalar(), F.lit(1))
    at = texts.select(*ident, words.alias("_words")).select(*ident, F.posexplode("_words").alias("_at", "_first"), "_words")
    at = at.select(*ident, "_first", F.slice("_words", F.col("_at") + 1, longest).alias("_ahead"))
    hit = at.join(g, "_first").where(F.slice("_ahead", F.lit(1), F.size("_parts")) == F.col("_parts"))
    return hit.groupBy(*ident, "term").agg(F.count("*").alias("hits"))


def term_locations(nodes: DataFrame, terms: DataFrame, node_key: list[str], text: str, term: str, most: int = 25) -> DataFrame:
    """The first nodes (in key order) that hold each term, at most ``most`` (a report's length)."""
    hits = glossary_hits(nodes, terms, node_key, text, term)
    n = F.row_number().over(Window.partitionBy("term").orderBy(*node_key))
    return hits.withColumn("rank", n).where(F.col("rank") <= most)


def in_range(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, label: str) -> DataFrame:
    """Each point with the label of the span that starts last at or before it (spans of a key do not overlap)."""
    a = spans.select(key, F.col(start).alias(at), F.lit(0).alias("_side"), F.col(label).alias("_label"))
    both = points.withColumn("_side", F.lit(1)).unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(label, F.last("_label", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_label")


def context_nodes(contexts: DataFrame, nodes: DataFrame, key: str, ident: str, context: str, node: str, text: str, sample: int = 80) -> DataFrame:
    """The node of each context: one that contains it, is contained in it, or holds its first ``sample`` characters."""
    c = contexts.select(key, ident, comparable(F.col(context)).alias("_c")).where("_c != ''")
    n = nodes.select(key, node, comparable(F.col(text)).alias("_t")).where("_t != ''")
    near = c.join(n, key)
    tier = F.when(F.contains("_t", F.col("_c")), 1).when(F.contains("_c", F.col("_t")), 2).when(F.contains("_t", F.substring("_c", 1, sample)), 3)
    found = near.withColumn("tier", tier).where("tier IS NOT NULL")
    return first_per(found, [key, ident], ["tier", node]).drop("_c", "_t")


def carry_state(new: DataFrame, old: DataFrame, keys: list[str], order: str, state: list[str]) -> DataFrame:
    """New items with the state of the old item on the first key that knows them; of equal old items the last counts."""
    out = new
    for k in keys:
        last = first_per(old.where(F.col(k).isNotNull()), [k], [F.desc(order)]).select(k, *[F.col(c).alias(f"_{k}_{c}") for c in state])
        out = out.join(last, k, "left")
    made = {c: F.coalesce(*(F.col(f"_{k}_{c}") for k in keys), *([F.col(c)] if c in new.columns else [])) for c in state}
    return out.withColumns(made).drop(*[f"_{k}_{c}" for k in keys for c in state])


def unresolved(findings: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that no resolved item answers on any of the keys."""
    return reduce(lambda f, k: f.join(resolved.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti"), keys, findings)


def import_decisions(queue: DataFrame, decisions: DataFrame, tiers: list[str], ident: str, decision: str) -> DataFrame:
    """Queue items with the decision of the first tier (a shared column) that matches; unmatched decisions are appended."""
    out, used = queue, None
    names = []
    for t in tiers:
        d = first_per(decisions.where(F.col(t).isNotNull()), [t], [decision]).select(t, F.col(decision).alias(f"_{t}"))
        out = out.join(d, t, "left")
        names.append(f"_{t}")
    merged = out.withColumn(decision, F.coalesce(*names, *([F.col(decision)] if decision in queue.columns else []))).withColumn("origin", F.lit("queue")).drop(*names)
    used = decisions
    for t in tiers:
        used = used.join(queue.select(t).where(F.col(t).isNotNull()).distinct(), t, "left_anti")
    extra = used.select(*[c for c in used.columns if c in queue.columns or c == decision]).withColumn("origin", F.lit("decision"))
    return merged.unionByName(extra, allowMissingColumns=True)


def coverage(expected: DataFrame, done: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Expected rows that were done, and those that were not."""
    return expected.join(done, key, "left_semi"), expected.join(done, key, "left_anti")


def orphans(entries: DataFrame, manifest: DataFrame, references: DataFrame, path: str) -> DataFrame:
    """Entries without manifest item, manifest items without entry, references to nothing: ``kind, path``."""
    tag = lambda d, k: d.select(F.lit(k).alias("kind"), F.col(path))
    return (
        tag(entries.join(manifest, path, "left_anti"), "not_in_manifest").unionByName(tag(manifest.join(entries, path, "left_anti"), "missing_entry")).unionByName(tag(references.join(manifest, path, "left_anti"), "missing_reference"))
    )


def with_overrides(rows: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """Manual rows are added only where the key is absent."""
    return rows.unionByName(overrides.join(rows, key, "left_anti"), allowMissingColumns=True)


def rewrite_links(links: DataFrame, mapping: DataFrame, keys: list[str], href: str) -> DataFrame:
    """References with their new path; those that the mapping does not know stay."""
    return links.join(mapping.select(*keys, F.col("new_path").alias("_new")), keys, "left").withColumn(href, F.coalesce("_new", F.col(href))).drop("_new")


def open_suggestions(queue: DataFrame, suggestions: DataFrame, ident: str) -> DataFrame:
    return queue.where("status = 'pending'").join(suggestions.where("applicable"), ident)


def with_reviews(chapters: DataFrame, reviews: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Chapters with their last review, reasons and verdict."""
    last = first_per(reviews, keys, [F.desc(order)])
    out = chapters.join(last, keys, "left")
    reasons = F.array_compact(F.array(F.when(F.col("confidence") < 0.6, "low_confidence"), F.when(F.col("review_status") == "rejected", "rejected"), F.when(F.col("review_status") == "doubtful", "doubtful")))
    return out.withColumn("reasons", F.concat_ws("; ", reasons)).withColumn("verdict", F.when(F.col("review_status") == "rejected", "FAIL").when(F.size(reasons) > 0, "WARN").otherwise("OK"))


def group_titles(rows: DataFrame, base: DataFrame, key: str, group: str, title: str, order: str) -> DataFrame:
    """Titles of groups: the base's, else the last one seen in the group."""
    seen = rows.where(F.col(title).isNotNull()).groupBy(key, group).agg(F.max_by(title, order).alias("_seen"))
    out = rows.join(base.select(key, group, F.col(title).alias("_base")), [key, group], "left").join(seen, [key, group], "left")
    return out.withColumn("group_title", F.coalesce("_base", "_seen")).drop("_base", "_seen")


def evidence(findings: DataFrame, sentences: DataFrame, key: str, ident: str, name: str, marker: Column, text: str, order: str) -> DataFrame:
    """For each finding a sentence of its chapter with name and marker, else one with the marker."""
    near = findings.join(sentences, key).where(marker)
    tier = F.when(F.contains(fold(F.col(text)), fold(F.col(name))), 1).otherwise(2)
    return first_per(near.withColumn("tier", tier), [key, ident], ["tier", order])


def same_text(a: Column, b: Column) -> Column:
    return compact(fold(a)) == compact(fold(b))
