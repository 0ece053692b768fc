"""Corrections: ordered, counted, scoped and idempotent edits of texts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions.text import comparable, count_term, has_term, term_regex, text_or_empty
from folioscope.operators.findings import union_all
from folioscope.operators.match import glossary_hits

#: An ordered rule: pattern and replacement (regular expressions of the engine).
Rules = list[tuple[str, str]]


def apply_rules(text: Column, rules: Rules) -> Column:
    """Rules in their order; each sees what those before it made."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def count_rules(df: DataFrame, ident: list[str], text: str, rules: Rules) -> DataFrame:
    """``ident, rule, hits``: hits of each rule on the text as it is when the rule's turn comes."""
    current, hits = text_or_empty(F.col(text)), []
    for i, (pattern, to) in enumerate(rules):
        hits.append(F.struct(F.lit(i).alias("rule"), F.regexp_count(current, F.lit(pattern)).alias("hits")))
        current = F.regexp_replace(current, pattern, to)
    return df.select(*ident, F.explode(F.array(*hits)).alias("x")).select(*ident, "x.*").where("hits > 0")


def replace_terms(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole-word replacements, longest first, ignoring case."""
    return apply_rules(text, [(term_regex(a), b.replace("\\", "\\\\").replace("$", "\\$")) for a, b in sorted(pairs, key=lambda p: (-len(p[0]), p[0]))])


def replace_from_table(df: DataFrame, rules: DataFrame, ident: list[str], text: str, term: str = "from_text", to: str = "to_text") -> DataFrame:
    """Texts with the table's terms replaced, longest first, and the number of replacements.

    The rules that occur in a text are found by a join on words; only those travel to it, as an array that is folded over.
    """
    hits = glossary_hits(df, rules, ident, text, term)
    chosen = rules.where(F.col(term).isNotNull() & F.col(to).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.min(to).alias("_to"))
    own = hits.join(chosen, "term").groupBy(*ident).agg(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("l"), "term", "_to"))).alias("_rules"), F.sum("hits").alias("replacements"))
    folded = F.aggregate("_rules", F.col(text), lambda t, r: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), r["term"], F.lit(r"\E(?![\p{L}\p{N}])")), F.regexp_replace(r["_to"], r"([\\$])", r"\\$1")))
    out = df.join(own, ident, "left")
    return out.withColumn("corrected", F.when(F.col("_rules").isNull(), F.col(text)).otherwise(folded)).withColumn("replacements", F.coalesce("replacements", F.lit(0))).drop("_rules")


@F.pandas_udf(StringType())
def replace_nth(texts: pd.Series, terms: pd.Series, tos: pd.Series, ns: pd.Series) -> pd.Series:
    """Only the n-th whole-word occurrence (from 0) is replaced; offsets need code."""

    def one(text, term, to, n):
        if text is None or not term or to is None or n is None or n != n:
            return text
        for i, m in enumerate(re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", text, re.I)):
            if i == int(n):
                return text[: m.start()] + to + text[m.end() :]
        return text

    return pd.Series([one(*x) for x in zip(texts, terms, tos, ns)])


def edit_scoped(text: str, edits: list[dict], least: float = 0.5) -> tuple[str, int]:
    """Edits against the original offsets, applied from right to left, one a range.

    An edit has ``from``, ``to`` and a ``context``: its range is the sentence most like the context.
    """
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^.!?…]+[.!?…]*\s*", text)] or [(0, len(text))]
    planned: list[tuple[int, int, str]] = []
    for e in edits:
        best = max(spans, key=lambda s: difflib.SequenceMatcher(None, text[s[0] : s[1]].lower(), (e.get("context") or "").lower()).ratio()) if e.get("context") else (0, len(text))
        if e.get("context") and difflib.SequenceMatcher(None, text[best[0] : best[1]].lower(), e["context"].lower()).ratio() < least:
            continue
        for m in re.compile(rf"(?<!\w){re.escape(e['from'])}(?!\w)", re.I).finditer(text, best[0], best[1]):
            if all(m.end() <= a or m.start() >= b for a, b, _ in planned):
                planned.append((m.start(), m.end(), e["to"]))
                break
    for a, b, to in sorted(planned, reverse=True):
        text = text[:a] + to + text[b:]
    return text, len(planned)


def apply_scoped(nodes: DataFrame, actions: DataFrame, key: list[str], text: str) -> DataFrame:
    """Nodes with their scoped edits (``from_text, to_text, context``) applied: ``corrected, applied``."""
    own = actions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("action_id").alias("id"), F.col("from_text").alias("from"), F.col("to_text").alias("to"), "context"))).alias("_edits"))

    @F.pandas_udf("struct<corrected: string, applied: int>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, edits in parts:
            rows = [(t, 0) if t is None or e is None else edit_scoped(t, [dict(x) for x in e]) for t, e in zip(texts, edits)]
            yield pd.DataFrame(rows, columns=["corrected", "applied"])

    return nodes.join(own, key, "left").withColumn("_x", run(F.col(text), F.col("_edits"))).withColumn("corrected", F.col("_x.corrected")).withColumn("applied", F.col("_x.applied")).drop("_x", "_edits")


def candidates(log: DataFrame, glossary: DataFrame, findings: DataFrame) -> DataFrame:
    """Correction candidates of three origins with their confidence and mode."""
    a = log.select(F.lit("log").alias("origin"), "from_text", "to_text", F.lit(0.98).alias("confidence"))
    b = glossary.select(F.lit("glossary").alias("origin"), "from_text", "to_text", F.coalesce(F.nanvl("confidence", F.lit(0.7)), F.lit(0.7)).alias("confidence"))
    c = findings.select(F.lit("finding").alias("origin"), "from_text", "to_text", F.when(F.col("severity") == "FAIL", 0.65).when(F.col("severity") == "WARN", 0.55).otherwise(0.0).alias("confidence"))
    rows = union_all(a, b, c).where("from_text IS NOT NULL")
    mode = F.when((F.col("origin") != "finding") & (F.col("confidence") >= 0.9) & F.col("to_text").isNotNull(), "auto_safe").when(F.col("confidence") >= 0.5, "auto_review").otherwise("manual_only")
    return rows.withColumn("mode", mode)


def plan(rows: DataFrame) -> DataFrame:
    """Actions with status by mode, risk and an explicit order."""
    status = F.when(F.col("mode") == "auto_safe", "ready").otherwise("pending")
    risk = F.when(F.col("mode") == "auto_safe", "low").when(F.col("mode") == "auto_review", "medium").otherwise("high")
    return rows.withColumn("status", status).withColumn("risk", risk).withColumn("length", -F.length("from_text"))


def validate_applied(before: DataFrame, after: DataFrame, actions: DataFrame, key: list[str], text: str) -> DataFrame:
    """Per text: whether it changed and whether it has every new form."""
    b = before.select(*key, F.col(text).alias("_b"))
    a = after.select(*key, F.col(text).alias("_a"))
    rows = actions.join(b, key).join(a, key)
    return rows.groupBy(*key).agg(F.bool_or(F.col("_a") != F.col("_b")).alias("changed"), F.bool_and(F.contains("_a", F.col("to_text"))).alias("all_present"), F.count("*").alias("actions"))


def mark_applied(queue: DataFrame, applied: DataFrame, ident: str = "id") -> DataFrame:
    """Items with the number of replacements and the status that follows from it."""
    n = applied.groupBy(ident).agg(F.sum("replacements").alias("_n"))
    out = queue.join(n, ident, "left")
    return out.withColumn("replacements_applied", F.coalesce("_n", F.lit(0))).withColumn("status", F.when(F.col("_n") > 0, "applied").otherwise(F.col("status"))).drop("_n")


def not_yet_applied(items: DataFrame, applied: DataFrame, ident: str = "id") -> DataFrame:
    """What a second run still has to do: nothing, if all was applied."""
    return items.join(applied.select(ident).distinct(), ident, "left_anti")


def best_node(actions: DataFrame, nodes: DataFrame, key: str, ident: str, context: str, text: str, node: str) -> DataFrame:
    """The node of each action: of the nodes of its document that hold the old form, the one most like the context."""
    near = actions.join(nodes, key).where(has_term(F.col(text), F.col("from_text")))
    a, b = F.split(comparable(F.col(context)), " "), F.split(comparable(F.col(text)), " ")
    alike = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    w = Window.partitionBy(ident).orderBy(F.desc("alike"), node)
    return near.withColumn("alike", alike).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def reviewed_replacement(df: DataFrame) -> DataFrame:
    """What an item changes: the reviewer's text, else the title, else the term."""
    pick = lambda *c: F.coalesce(*(F.when(F.trim(F.col(x)) != "", F.col(x)) for x in c))
    return df.withColumn("from_text", pick("reviewed_from", "title_from", "term_from")).withColumn("to_text", pick("reviewed_to", "title_to", "term_to"))


def decide(df: DataFrame) -> DataFrame:
    """Status after a reader's decision: keep, apply, edit or ask."""
    status = F.when(F.col("decision").isin("apply", "edit"), "approved").when(F.col("decision") == "keep", "rejected").when(F.col("decision") == "ask", "needs_context").otherwise(F.col("status"))
    after = F.when(F.col("decision") == "edit", F.col("edited")).otherwise(F.col("after"))
    return df.withColumn("status", status).withColumn("after", after)


def first_replacement(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The first pair that occurs replaces its first match (pronouns by an aligned signal)."""
    out = F.lit(None).cast("string")
    for a, b in reversed(pairs):
        at = F.regexp_instr(text, F.lit(term_regex(a)))
        out = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(b), F.substring(text, at + len(a), F.length(text)))).otherwise(out)
    return out


def gender_signal(text: Column, male: list[str], female: list[str]) -> Column:
    n = lambda words: sum((count_term(text, w) for w in words), F.lit(0))
    m, f = n(male), n(female)
    return F.when((m > 0) & (f == 0), "male").when((f > 0) & (m == 0), "female").otherwise("unknown")


def merge_books(parts: DataFrame, order: list[str], chapter: str, path: str, digest: str) -> DataFrame:
    """Chapters of ordered sources in one sequence; equal resources once."""
    w = Window.partitionBy("book_id").orderBy(*order)
    return parts.withColumn("position", F.row_number().over(w)).dropDuplicates(["book_id", path, digest])


def merged_errors(expected: DataFrame, actual: DataFrame, key: str, member: str) -> DataFrame:
    """Members that a merged package lacks, and those nobody expected."""
    a = expected.join(actual, [key, member], "left_anti").select(key, member, F.lit("MISSING").alias("code"))
    b = actual.join(expected, [key, member], "left_anti").select(key, member, F.lit("UNEXPECTED").alias("code"))
    return a.unionByName(b)
