"""The queries ``pN_...`` over the project tables, and SQL twins where SQL can express the problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import alignment, langid, names, packing, responses, sitelines, splitting, tokenizer, truncation
from folioscope.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = alignment.align(table(spark, sf_dir, "text_nodes"), table(spark, sf_dir, "books"))
    a, b = F.col("source_node"), F.col("target_node")
    return pairs.select(F.least(a, b).alias("node_a"), F.greatest(a, b).alias("node_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entity_pairs(table(spark, sf_dir, "entities"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = names.link_entities(table(spark, sf_dir, "entities"))
    return linked.groupBy("book_id", "label").agg(F.count("*").alias("records"), F.min("entity_id").alias("first_record"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = sitelines.repeated_lines(table(spark, sf_dir, "chapters"))
    return found.select("chapter_id", "paragraph_index").distinct()


def p3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, sf_dir, "chapters"))[1]


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters")
    found, _ = sitelines.repeated_lines(chapters)
    clean = sitelines.without_repeated(chapters.dropDuplicates(["chapter_id"]), found)
    return clean.select("chapter_id", "paragraphs", "removed")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.defects(*(table(spark, sf_dir, t) for t in ("chunks", "chapters", "sections")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.wrong_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_reports"))
    return found.select("doc_id", "line_no", "lang")


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, langid.latest_reports(table(spark, sf_dir, "language_reports")))
    return langid.detect(documents, model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "chapters"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chapters"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come back changed from encoding and decoding by byte_bpe_multi_50k: none, counted by kind."""
    documents = table(spark, sf_dir, "documents")
    name = "byte_bpe_multi_50k"
    back = tokenizer.decode_ids(tokenizer.encode_texts(documents, name=name), name=name).withColumnRenamed("text", "back")
    same = documents.select("doc_id", "kind", "text").join(back, "doc_id")
    return same.groupBy("kind").agg(F.count("*").alias("texts"), F.count_if(F.coalesce("text", F.lit("")) != F.col("back")).alias("changed"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    fill = packing.container_fill(packing.pack_texts(table(spark, sf_dir, "documents")))
    total = fill.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
    return total.withColumn("fill", F.col("used") / (F.col("containers") * packing.CAPACITY))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = truncation.truncated(table(spark, sf_dir, "documents"))
    return judged.where("cut").select("doc_id").distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.shares(truncation.truncated(table(spark, sf_dir, "documents"))[0])


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))[1]


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_entities, p3_found, p3_templates, p3_clean, p4_found, p5_found, p5_languages, p6_found, p6_pieces,
        p7_ids, p7_round_trip, p8_packing, p8_fill, p9_found, p9_shares, p9_limits,
    )
}

SITE = r"""
  SELECT chapter_id, paragraphs,
         regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^([a-z][a-z0-9+.\-]*:)?//', ''), '^[^/?#\\\s]*'), '^.*@', ''), ':\d*$', '') AS host
  FROM chapters WHERE url IS NOT NULL
"""

ORACLE: dict[str, str] = {
    "p3_found": rf"""
WITH docs AS (SELECT chapter_id, paragraphs, CASE WHEN regexp_matches(host, '[^.]+\.[^.]+$') THEN regexp_extract(host, '[^.]+\.[^.]+$') ELSE host END AS site FROM ({SITE}) WHERE host <> ''),
sizes AS (SELECT site, count(DISTINCT chapter_id) AS n FROM docs GROUP BY site),
lines AS (SELECT DISTINCT site, chapter_id, i - 1 AS paragraph_index, lower(regexp_replace(paragraphs[i], '[^\p{{L}}]+', '', 'g')) AS line
          FROM (SELECT site, chapter_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS i FROM docs)),
counted AS (SELECT site, line, count(DISTINCT chapter_id) AS n FROM lines WHERE line <> '' GROUP BY site, line),
repeated AS (SELECT c.site, c.line FROM counted c JOIN sizes s USING (site) WHERE c.n >= 5 AND c.n * 10 >= s.n)
SELECT DISTINCT chapter_id, CAST(paragraph_index AS BIGINT) AS paragraph_index FROM lines JOIN repeated USING (site, line)
""",
    "p6_found": """
SELECT DISTINCT chapter_id, CAST(i - 1 AS BIGINT) AS paragraph_index
FROM (SELECT chapter_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS i FROM chapters)
WHERE length(paragraphs[i]) > 3000
""",
}
