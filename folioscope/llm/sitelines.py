"""Problem 3: lines repeated across one site's documents.

Method. A line is reduced to its letters (Unicode category L, case folded) and cut into fixed-width segments, its
tokens. A token tree of fixed depth leads from the site over the number of segments and the first segments to a leaf;
in a leaf, lines that share most segments form one template, the differing ones become wildcard slots. Trees grow in
the partitions (keys are dealt by a hash, so a hot leaf is shared by many tasks), and the templates of one leaf are
merged across the partitions. A leaf or template that covers too few documents cannot hold a repeated line and is
pruned, leaves before anything is moved but their hashes; an exact count of the lines of the templates left follows.

Defined results: a line without letters, a null line and a document without host are never found; two lines are the same
if their letters are; repeated rows of a document count once; a site is the last two labels of the host.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import staged

#: Letters in a segment, segments that lead to a leaf, share of equal segments within a template, parts of a leaf.
WIDTH, DEPTH, ALIKE, PARTS = 5, 2, 0.6, 16
MIN_DOCS, MIN_SHARE = 5, 10  # at least 5 documents, and one in ten


def site_of(url: Column) -> Column:
    """Last two labels of the host, lower case, without port and user; null if there is no host."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"^([a-z][a-z0-9+.\-]*:)?//", "")
    host = F.regexp_extract(u, r"^[^/?#\\\s]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""), r"\.+$", "")
    short = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    found = F.when(short != "", short).otherwise(host)
    return F.when(found != "", found)


def letters_of(text: Column) -> Column:
    """Letters of a text, ignoring case: what makes two lines the same."""
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}]+", "")))


def leaf_of(key: Column) -> Column:
    """Hash of a line's way down the tree: number of segments and the first segments."""
    n = F.ceil(F.length(key) / WIDTH)
    return F.xxhash64(n, F.substring(key, 1, WIDTH * DEPTH))


def segments(key: str) -> list[str]:
    return [key[i : i + WIDTH] for i in range(0, len(key), WIDTH)]


class Leaf:
    """The templates of one leaf. Segments beyond the way down are indexed by place, so a line is held only against the
    templates that share one with it, not against all of the leaf."""

    def __init__(self) -> None:
        self.templates: list[list[str]] = []
        self.at: dict[tuple[int, str], list[int]] = {}

    def grow(self, parts: list[str]) -> int:
        """Put a line into the leaf: the number of the first template that took it, which may get new wildcards."""
        n = len(parts)
        shared = Counter(i for k in range(DEPTH, n) for i in self.at.get((k, parts[k]), ()) if self.templates[i][k] == parts[k])
        # The way down is equal within a leaf; where it alone is alike enough, every template is a candidate.
        near = range(len(self.templates)) if DEPTH >= ALIKE * n else sorted(shared)
        for i in near:
            t = self.templates[i]
            if len(t) == n and sum(a == b for a, b in zip(t[:DEPTH], parts)) + shared[i] >= ALIKE * n:
                self.templates[i] = [a if a == b else "*" for a, b in zip(t, parts)]
                for k in range(DEPTH, n):
                    if t[k] != parts[k] and t[k] != "*":
                        self.at.setdefault((k, "*"), []).append(i)
                return i
        self.templates.append(parts)
        for k in range(DEPTH, n):
            self.at.setdefault((k, parts[k]), []).append(len(self.templates) - 1)
        return len(self.templates) - 1


def repeated_lines(df: DataFrame, id_col: str = "chapter_id", url_col: str = "url", array_col: str = "paragraphs", min_docs: int = MIN_DOCS, min_share: int = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """The occurrences ``(id, paragraph_index, site, key)`` of repeated lines, and the templates that hold them."""
    docs = df.select(F.col(id_col).alias("_id"), site_of(F.col(url_col)).alias("site"), F.col(array_col).alias("_lines")).where("site IS NOT NULL")
    sites = docs.select("site", "_id").distinct().groupBy("site").agg(F.count("*").alias("_docs"))
    least = F.greatest(F.lit(min_docs).cast("bigint"), F.ceil(F.col("_docs") / min_share))

    leaves = docs.select("site", "_id", F.explode(F.array_distinct(F.transform("_lines", lambda p: leaf_of(letters_of(p))))).alias("_leaf"))
    wide = (
        leaves.distinct().groupBy("site", "_leaf").agg(F.count("*").alias("_cover"))
        .where(F.col("_cover") >= min_docs)
        .join(sites, "site").where(F.col("_cover") >= least)
        .select("site", "_leaf", least.alias("_least"))
    )
    lines = docs.select("site", "_id", F.posexplode("_lines").alias("paragraph_index", "_text")).withColumn("_key", letters_of(F.col("_text"))).where("_key != ''")
    lines = lines.select("site", "_id", F.col("paragraph_index").cast("bigint").alias("paragraph_index"), "_key", leaf_of(F.col("_key")).alias("_leaf"))
    near = staged(lines.join(wide, ["site", "_leaf"]).distinct())

    keys = near.select("site", "_leaf", "_least", "_key", "_id").distinct().groupBy("site", "_leaf", "_least", "_key").agg(F.count("*").alias("n_docs"))
    keys = keys.repartition("site", "_leaf", F.pmod(F.xxhash64("_key"), F.lit(PARTS))).sortWithinPartitions("site", "_leaf", "_key")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree = None, Leaf()  # rows come leaf by leaf, so one leaf is held at a time
        for f in frames:
            made = []
            for s, leaf, k in zip(f["site"], f["_leaf"], f["_key"]):
                if (s, leaf) != at:
                    at, tree = (s, leaf), Leaf()
                made.append((tree, tree.grow(segments(k))))
            yield f.assign(_local=["|".join(t.templates[i]) for t, i in made])

    grown = staged(keys.mapInPandas(local, "site string, _leaf bigint, _least bigint, _key string, n_docs bigint, _local string"))

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", "_local"], ascending=[False, True], kind="stable")
        tree = Leaf()
        taken = [tree.grow(t.split("|")) for t in f["_local"]]
        return f.assign(template=["|".join(tree.templates[i]) for i in taken])[["site", "_leaf", "_local", "template"]]

    parts = grown.groupBy("site", "_leaf", "_local").agg(F.sum("n_docs").alias("n"))
    trees = parts.groupBy("site", "_leaf").agg(F.count("*").alias("_trees"), F.min("_local").alias("_only"))
    several = parts.join(trees.where("_trees > 1").select("site", "_leaf"), ["site", "_leaf"])
    merged = several.repartition(df.sparkSession.sparkContext.defaultParallelism, "site", "_leaf").groupBy("site", "_leaf").applyInPandas(merge, "site string, _leaf bigint, _local string, template string")
    merged = staged(merged.unionByName(trees.where("_trees = 1").select("site", "_leaf", F.col("_only").alias("_local"), F.col("_only").alias("template"))))
    known = grown.join(merged, ["site", "_leaf", "_local"])
    templates = known.groupBy("site", "_leaf", "template").agg(
        F.sum("n_docs").alias("covered"), F.max("n_docs").alias("most_docs"), F.count("*").alias("n_lines"), F.first("_least").alias("least")
    ).where(F.col("covered") >= F.col("least"))
    held = known.join(templates.select("site", "_leaf", "template"), ["site", "_leaf", "template"])
    exact = held.where(F.col("n_docs") >= F.col("_least")).select("site", "_leaf", "_key", "template", "n_docs")
    found = near.join(exact, ["site", "_leaf", "_key"]).select(F.col("_id").alias(id_col), "paragraph_index", "site", F.col("_key").alias("line"), "template")
    return found, templates.select("site", "template", "covered", "most_docs", "n_lines", "least")


def without_repeated(df: DataFrame, found: DataFrame, id_col: str = "chapter_id", array_col: str = "paragraphs") -> DataFrame:
    """Every row with its array as it is without the found lines; ``removed`` counts them."""
    # Names that no input column has, so that extra columns of any name stay untouched.
    out = found.groupBy(F.col(id_col).alias("__found_id")).agg(F.collect_set(F.col("paragraph_index").cast("int")).alias("__found"))
    joined = df.join(out, df[id_col] == out["__found_id"], "left")
    kept = F.when(F.col("__found").isNull(), F.col(array_col)).otherwise(F.filter(F.col(array_col), lambda p, i: ~F.array_contains("__found", i)))
    return joined.withColumn(array_col, kept).withColumn("removed", F.when(F.col("__found").isNull(), 0).otherwise(F.size("__found"))).drop("__found_id", "__found")
