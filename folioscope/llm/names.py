"""Problem 2: variant spellings of names typed by people.

Method. Every name of a record is turned into forms (``nameforms``). Whole forms, of any length, are looked up by one
pigeonhole segment join: the names of a book are cut into k+1 segments, kept in an inverted index with their length and
number; a name within k edits must contain one of the segments unchanged and shifted by at most k, so its position-shifted
substrings find all candidates by equality, which a banded edit distance verifies. Two records whose forms are no edit
apart are linked; a name that is no known spelling is linked to the nearest known name if that is one entity. Records that hold no
whole name (initials, a part, an acronym) are linked if exactly one entity of the book fits.

A part of a name is known if it occurs in enough records of the whole table; two names of known parts are not taken for
misspellings of each other, so relatives stay apart. The same misspelling gets as many records in a large table, too: a
name is looked up all the same if the book holds one within k edits, each differing part of which is ``COMMONER`` times
as frequent. That ratio does not change with the size of the table. Links are closed to components. Defined results: null and
blank names give no link; records without book are left out; repeated rows count once; a record that fits several
entities equally stays alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.graph import components
from folioscope.llm.nameforms import NICKNAMES, forms
from folioscope.session import staged

#: Records that must hold a part of a name for it to be known.
KNOWN = 3
#: How many times as frequent a part must be for a known part near it to be its misspelling.
COMMONER = 10


def name_forms(entities: DataFrame) -> DataFrame:
    """``node, book_id, entity_id, kind, key, a, b`` of all names; node is a hash of book and entity."""
    aliases = F.transform(F.coalesce(F.col("aliases"), F.array()), lambda x: x["from_text"])
    names = (
        entities.where("book_id IS NOT NULL AND entity_id IS NOT NULL")
        .select("book_id", "entity_id", F.explode(F.array_distinct(F.concat(F.array("canonical", "original_name"), aliases))).alias("name"))
        .where("length(trim(name)) > 0")
        .distinct()
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(book, entity, *form) for book, entity, name in f.itertuples(index=False, name=None) for form in forms(name)]
            yield pd.DataFrame(rows, columns=["book_id", "entity_id", "kind", "key", "a", "b"])

    found = names.mapInPandas(run, "book_id bigint, entity_id bigint, kind string, key string, a string, b string").distinct()
    return found.withColumn("node", F.xxhash64("book_id", "entity_id"))


def near_keys(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs ``book_id, space, source, target, edits`` of keys within the source's ``k`` edits (pigeonhole segment join).

    ``sources``: book_id, space, source, k (0, 1 or 2); ``targets``: book_id, space, target. With k = 0 the key is its own
    only segment; a key that is a target finds itself, 0 edits away.
    """
    length, parts = F.col("_length"), F.col("k") + 1
    start, end = (F.floor((F.col("_part") + x) * length / parts).cast("int") for x in (0, 1))
    index = (
        targets.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("_length", F.length("target")).where(length > F.col("k"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .select("book_id", "space", "k", "_length", "_part", F.col("target").substr(start + 1, end - start).alias("_segment"), "target")
    )
    n, at = F.length("source"), start + F.col("_shift")
    probe = (
        sources.withColumn("_length", F.explode(F.sequence(n - F.col("k"), n + F.col("k")))).where(length > F.col("k"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("_shift", F.explode(F.sequence(-F.col("k"), F.col("k"))))
        .where((at >= 0) & (end + F.col("_shift") <= n))
        .select("book_id", "space", "k", "_length", "_part", F.col("source").substr(at + 1, end - start).alias("_segment"), "source")
        .distinct()
    )
    pairs = probe.join(index, ["book_id", "space", "k", "_length", "_part", "_segment"]).select("book_id", "space", "source", "target", "k").distinct()
    return pairs.withColumn("edits", F.expr("levenshtein(source, target, k)")).where("edits BETWEEN 0 AND k").drop("k")


def lone_forms(known: DataFrame) -> DataFrame:
    """What a record without whole name may be looked up by: ``space, key, q`` of the records that hold whole names."""
    first = lambda c: F.substring(c, 1, 1)
    none = F.lit("")
    rows = F.expr("CAST(NULL AS array<struct<space: string, key: string, q: string>>)")
    of = lambda *r: F.array(*(F.struct(F.lit(s).alias("space"), F.col(k).alias("key"), q.alias("q")) for s, k, q in r))
    cut = F.transform(F.when(F.length("a") > 3, F.sequence(F.lit(3), F.length("a") - 1)), lambda i: F.struct(F.lit("short").alias("space"), F.col("b").alias("key"), F.substring(F.col("a"), F.lit(1), i).alias("q")))
    # Initials stand for the full first name, which is among the forms of a nickname, too.
    short = sorted({n for ns in NICKNAMES.values() for n in ns.split()} - set(NICKNAMES))
    named = F.when(F.col("a").isin(short), of(("given", "a", none), ("cut", "a", first("b")))).otherwise(of(("initial", "b", first("a")), ("given", "a", none), ("cut", "a", first("b"))))
    kinds = (
        F.when(F.col("kind") == "full", F.concat(named, F.coalesce(cut, F.array())))
        .when(F.col("kind") == "sound", of(("soundgiven", "b", none)))
        .when(F.col("kind") == "soundletters", of(("soundinitial", "key", F.col("a"))))
        .when(F.col("kind") == "orghead", of(("head", "key", none), ("orginitial", "b", first("key"))))
        .when(F.col("kind") == "orgletters", of(("acronym", "key", none)))
        .otherwise(rows)
    )
    return known.select("node", "book_id", F.inline(kinds)).where("key != ''").distinct()


def lone_queries(lone: DataFrame) -> DataFrame:
    """The same for the records that are looked up, with the tier of each lookup (lower is surer)."""
    q = F.when(F.col("kind").isin("initial", "cut"), F.substring("a", 1, 1)).when(F.col("kind").isin("soundinitial", "short", "orginitial"), F.col("a")).otherwise(F.lit(""))
    spaces = F.when(F.col("kind") == "cut", F.array(F.lit("cut"), F.lit("initial"))).otherwise(F.array("kind"))
    tier = F.when(F.col("kind").isin("initial", "cut", "soundinitial"), 1).otherwise(2)
    asked = lone.where(F.col("kind").isin("initial", "cut", "soundinitial", "given", "soundgiven", "short", "head", "orginitial", "acronym"))
    return asked.select("node", "book_id", F.explode(spaces).alias("space"), "key", q.alias("q"), tier.alias("tier")).distinct()


def link_entities(entities: DataFrame, known: int = KNOWN) -> DataFrame:
    """``book_id, entity_id, label``: records of one entity have one label; records without link are left out."""
    rows = staged(name_forms(entities))
    whole = rows.where("kind IN ('full', 'sound')").withColumnRenamed("kind", "space")
    joined = rows.where("kind IN ('joined', 'soundjoined')")
    joined = joined.withColumn("space", F.when(F.col("kind") == "joined", "full").otherwise("sound"))

    part = whole.select("space", "node", F.explode(F.array("a", "b")).alias("part")).distinct().groupBy("space", "part").agg(F.count("*").alias("n"))
    counted = lambda c: part.select("space", F.col("part").alias(c), F.col("n").alias(f"{c}_n"))
    ways = whole.select("space", "key", "a", "b").distinct().join(counted("a"), ["space", "a"]).join(counted("b"), ["space", "b"])
    ways = ways.groupBy("space", "key").agg(F.max(F.struct(F.least("a_n", "b_n").alias("least"), "a", "b", "a_n", "b_n")).alias("way"))
    keys = whole.groupBy("book_id", "space", "key").agg(F.min("node").alias("holder")).join(ways, ["space", "key"])
    keys = staged(keys.withColumn("often", F.col("way.least") >= known))

    held = whole.select("node", "book_id", "space", "key").unionByName(joined.select("node", "book_id", "space", "key")).distinct()
    # Edits by length, as a share of the name: one from 4 letters on, two from 8.
    allowed = F.when(F.length("source") < 4, 0).when(F.length("source") < 8, 1).otherwise(2)
    found = staged(near_keys(
        held.select("book_id", "space", F.col("key").alias("source")).distinct().select("book_id", "space", "source", allowed.alias("k")),
        keys.select("book_id", "space", F.col("key").alias("target")),
    ))
    same = found.where("edits = 0").select("book_id", "space", F.col("source").alias("key"))
    exact = held.join(same, ["book_id", "space", "key"]).join(keys, ["book_id", "space", "key"]).select(F.col("node").alias("a"), F.col("holder").alias("b"))
    near = found.where("edits > 0")
    own = keys.select("book_id", "space", F.col("key").alias("source"), F.col("way").alias("own"), F.col("often").alias("own_often"))
    near = near.join(keys.select("book_id", "space", F.col("key").alias("target"), "way"), ["book_id", "space", "target"]).join(own, ["book_id", "space", "source"], "left")
    commoner = [(F.col(f"way.{c}") == F.col(f"own.{c}")) | (F.col(f"way.{c}_n") >= COMMONER * F.col(f"own.{c}_n")) for c in ("a", "b")]
    near = staged(near.where(~F.coalesce("own_often", F.lit(False)) | (commoner[0] & commoner[1])).select("book_id", "space", "source", "target", "edits", F.coalesce("own_often", F.lit(False)).alias("own_often")))
    doubted = near.where("own_often").select("book_id", "space", F.col("source").alias("key")).distinct().withColumn("doubted", F.lit(True))
    keys = staged(keys.join(doubted, ["book_id", "space", "key"], "left").select("book_id", "space", "key", "holder", (F.col("often") & F.col("doubted").isNull()).alias("sure")))
    near = near.drop("own_often")
    unknown = held.join(keys.where("sure").select("book_id", "space", "key"), ["book_id", "space", "key"], "left_anti").withColumnRenamed("key", "source")
    first = staged(components(exact))
    best = near.join(keys.select("book_id", "space", F.col("key").alias("target"), "holder", "sure"), ["book_id", "space", "target"])
    best = best.join(first, F.col("holder") == F.col("node"), "left").select("book_id", "space", "source", F.coalesce("label", "holder").alias("to"), F.struct(~F.col("sure"), F.col("edits")).alias("rank"))
    least = best.groupBy("book_id", "space", "source").agg(F.min("rank").alias("rank"))
    best = best.join(least, ["book_id", "space", "source", "rank"]).groupBy("book_id", "space", "source").agg(F.min("to").alias("b"), F.max("to").alias("other")).where("b = other")
    misspelt = unknown.join(best, ["book_id", "space", "source"]).select(F.col("node").alias("a"), "b")
    links = staged(exact.unionByName(misspelt).distinct())
    second = staged(components(links))

    strong = whole.select("node").distinct()
    words = rows.groupBy("node").agg(F.max(F.when(F.col("kind").isin("sound", "orghead"), 1).otherwise(0)).alias("more"), F.count(F.when(F.col("kind") == "full", 1)).alias("fulls"), F.count(F.when(F.col("kind") == "head", 1)).alias("heads"))
    alone = words.where("more = 0 AND (fulls = 0 OR heads > 0)").join(second, "node", "left_anti").select("node", "fulls")
    asked = lone_queries(rows.join(alone, "node").where("fulls = 0 OR kind IN ('short', 'head')"))
    index = lone_forms(rows.join(strong, "node", "left_semi")).join(second, "node", "left").select("book_id", "space", "key", "q", F.coalesce("label", "node").alias("to"), F.col("node").alias("_own")).distinct()
    hits = asked.join(index, ["book_id", "space", "key", "q"]).where("node != _own").groupBy("node", "tier").agg(F.min("to").alias("to"), F.max("to").alias("other"))
    chosen = hits.groupBy("node").agg(F.min(F.struct("tier", "to", "other")).alias("x")).where("x.to = x.other").select("node", F.col("x.to").alias("label"))
    chosen = staged(chosen)
    # An entity may itself be a single record: it takes its own node as label. Two lone records may choose each other.
    tops = chosen.select("label").distinct().join(second.select(F.col("node").alias("label")), "label", "left_anti").join(chosen.select(F.col("node").alias("label")), "label", "left_anti")
    labels = second.unionByName(chosen).unionByName(tops.select(F.col("label").alias("node"), "label"))
    final = labels.groupBy("node").agg(F.min("label").alias("label"))
    nodes = rows.select("node", "book_id", "entity_id").distinct()
    return nodes.join(final, "node").select("book_id", "entity_id", "label")


def entity_pairs(entities: DataFrame) -> DataFrame:
    """``entity_a, entity_b``: all pairs of records of one entity."""
    linked = staged(link_entities(entities))
    left, right = (linked.select("book_id", "label", F.col("entity_id").alias(x)) for x in ("entity_a", "entity_b"))
    return left.join(right, ["book_id", "label"]).where("entity_a < entity_b").select("entity_a", "entity_b").distinct()
