"""Queries over joins, windows, sets, segments, roll-ups, detectors, corrections and states, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import aggregate, align, correct, detect, findings, match, models, segment, state, validate, windows
from folioscope.plans.catalog import BOOKS, FIX, HEADING, HITS, LINES, MARKERS, PAIRED, RULE_SQL, SECTIONS, WORDS, editions, lines_of, paired_sections, query, rule_findings
from folioscope.plans.catalog_text import comparable, compact, fold
from folioscope.session import table

PAIRED_FULL = PAIRED.replace("f s JOIN f t ON s.book_id = t.book_id AND s.section_index = t.section_index AND s.edition = 'source' AND t.edition = 'translation' AND s.r = 1 AND t.r = 1", "(SELECT * FROM f WHERE edition = 'source' AND r = 1) s FULL JOIN (SELECT * FROM f WHERE edition = 'translation' AND r = 1) t ON s.book_id = t.book_id AND s.section_index = t.section_index").replace("s.book_id || '-' || s.section_index", "coalesce(s.book_id, t.book_id) || '-' || coalesce(s.section_index, t.section_index)").replace("array_to_string(s.paragraphs, chr(10))", "CASE WHEN s.section_id IS NOT NULL THEN coalesce(array_to_string(s.paragraphs, chr(10)), '') END").replace("array_to_string(t.paragraphs, chr(10))", "CASE WHEN t.section_id IS NOT NULL THEN coalesce(array_to_string(t.paragraphs, chr(10)), '') END")


def sections_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sections").dropDuplicates(["section_id"])


# Windows and segments ----------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT DISTINCT section_id, node_key, node_id, text FROM text_nodes), p AS (SELECT *, lag(contains(text, 'Guild')) OVER (PARTITION BY section_id ORDER BY node_key, node_id) AS m FROM n) SELECT node_id FROM p WHERE m AND regexp_matches(text, '^\\s*[—“\"]')")
def after_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "text_nodes").select("section_id", "node_key", "node_id", "text").distinct()
    return windows.after_mention(n, ["section_id"], ["node_key", "node_id"], F.contains("text", F.lit("Guild")), F.col("text").rlike('^\\s*[—“"]')).select("node_id")


@query(f"WITH s AS (SELECT *, lead(section_index) OVER w AS n, lead(section_id) OVER w AS t FROM {SECTIONS} WINDOW w AS (PARTITION BY book_id, edition, chapter_number ORDER BY section_index, section_id)) SELECT section_id, t AS next_title FROM s WHERE n - section_index <= 1")
def nearby_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.nearby_duplicates(sections_once(spark, sf_dir), ["book_id", "edition", "chapter_number"], "section_index", "section_id").select("section_id", "next_title")


@query("SELECT doc_id, report_id, metadata_language FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY generated_at DESC NULLS LAST, report_id DESC) AS r FROM (SELECT DISTINCT * FROM language_reports)) WHERE r = 1")
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.keep_last(table(spark, sf_dir, "language_reports").distinct(), ["doc_id"], ["generated_at", "report_id"]).select("doc_id", "report_id", "metadata_language")


@query("SELECT doc_id, source, format('cand-{:04d}', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS id FROM documents")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "cand", ["source"], ["doc_id"])


@query(rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS token FROM documents), lexicon(token, lang) AS (VALUES {MARKERS}), total AS (SELECT doc_id, count(*) AS words FROM words GROUP BY doc_id),
score AS (SELECT doc_id, lang, round(count(*) / any_value(words), 6) AS score FROM words JOIN lexicon USING (token) JOIN total USING (doc_id) GROUP BY doc_id, lang),
r AS (SELECT *, row_number() OVER w AS r, round(score - coalesce(lead(score) OVER w, 0.0), 6) AS margin FROM score WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, lang))
SELECT doc_id, lang, margin, score >= 0.1 AND margin >= 0.05 AS safe FROM r WHERE r = 1
""")
def best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame([(w, lang, False) for lang, ws in detect.MARKERS.items() for w in ws], "token string, lang string, strong boolean")
    scores = aggregate.word_language(table(spark, sf_dir, "documents"), ["doc_id"], "text", lexicon)
    return align.best_with_margin(scores, ["doc_id"], "lang", "score", 0.1, 0.05).select("doc_id", "lang", "margin", "safe")


@query(f"WITH l AS ({LINES}) SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) / 5) AS INT) AS chunk_no, line_no FROM l")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.fixed_chunks(lines_of(spark, sf_dir), ["doc_id"], ["line_no"], 5).select("doc_id", "chunk_no", "line_no")


@query(f"WITH l AS ({LINES}), f AS (SELECT *, min(CASE WHEN regexp_matches(line, '{HEADING}') THEN line_no END) OVER (PARTITION BY doc_id) AS first FROM l) SELECT doc_id, line_no FROM f WHERE line_no < first")
def before_first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.before_first(lines_of(spark, sf_dir), "doc_id", "line_no", F.col("line").rlike(HEADING)).select("doc_id", "line_no")


@query(rf"""
WITH l AS ({LINES}), m AS (SELECT *, regexp_matches(line, '{HEADING}') AS m FROM l), s AS (SELECT *, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS segment FROM m)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, max(CASE WHEN m THEN line END) AS heading, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT m), '')) AS digest, count(*) FILTER (NOT m) AS lines FROM s GROUP BY doc_id, segment
""")
def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.segment_texts(lines_of(spark, sf_dir), ["doc_id"], ["line_no"], F.col("line").rlike(HEADING), "line")
    return out.select("doc_id", F.col("segment").cast("bigint").alias("segment"), "heading", F.md5("body").alias("digest"), "lines")


@query(rf"""
WITH l AS ({LINES}), s AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '{HEADING}') THEN line_no || ' ' || line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS label FROM l)
SELECT doc_id, label, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest, count(*) AS nodes FROM s WHERE label IS NOT NULL GROUP BY doc_id, label
""")
def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    starts = lines.where(F.col("line").rlike(HEADING)).select("doc_id", "line_no", F.concat_ws(" ", "line_no", "line").alias("label"))
    return segment.range_texts(lines, starts, "doc_id", "line_no", "label", "line").select("doc_id", "label", F.md5("line").alias("digest"), "nodes")


@query("WITH r AS (SELECT DISTINCT * FROM language_reports) SELECT report_id, last_value(metadata_language IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY report_id ROWS UNBOUNDED PRECEDING) AS metadata_language FROM r")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.carry_forward(table(spark, sf_dir, "language_reports").distinct(), ["doc_id"], ["report_id"], "metadata_language").select("report_id", "metadata_language")


@query(f"SELECT section_id, chapter_number FROM (SELECT *, row_number() OVER (PARTITION BY book_id, edition, chapter_number ORDER BY section_id DESC) AS r FROM {SECTIONS}) WHERE r = 1")
def last_per_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.last_per_number(sections_once(spark, sf_dir), ["book_id", "edition"], "chapter_number", "section_id").select("section_id", "chapter_number")


@query("SELECT DISTINCT node_id, md5(text) AS digest, false AS has_name FROM text_nodes WHERE text IS NOT NULL")
def protect_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Guild", "river", "House"]
    kept = segment.protect(F.col("text"), names)
    return table(spark, sf_dir, "text_nodes").where("text IS NOT NULL").select("node_id", F.md5(segment.restore(kept, names)).alias("digest"), kept.rlike(r"(?<![\p{L}\p{N}])(?:Guild|river|House)(?![\p{L}\p{N}])").alias("has_name")).distinct()


@query(f"WITH p AS (SELECT DISTINCT chapter_id, generate_subscripts(paragraphs, 1) - 1 AS no, unnest(paragraphs) AS text FROM chapters), k AS (SELECT *, {compact(f'regexp_replace({fold(chr(116) + chr(101) + chr(120) + chr(116))}, chr(91) || chr(94) || chr(92) || chr(119) || chr(92) || chr(115) || chr(93), chr(32), chr(103))')} AS k FROM p), r AS (SELECT *, row_number() OVER w AS r, first_value(k) OVER w AS f FROM k WINDOW w AS (PARTITION BY chapter_id ORDER BY no)) SELECT chapter_id, count(*) AS kept FROM r WHERE r = 1 OR r > 3 OR k <> f GROUP BY chapter_id")
def without_repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "chapters").select("chapter_id", F.posexplode("paragraphs").alias("no", "text")).distinct()
    return validate.without_repeated_headings(p, ["chapter_id"], "no", "text").groupBy("chapter_id").agg(F.count("*").alias("kept"))


# Joins -------------------------------------------------------------------------------------------------------------------


@query(f"WITH p AS (SELECT DISTINCT path FROM {SECTIONS} WHERE edition = 'source'), q AS (SELECT DISTINCT path FROM {SECTIONS} WHERE edition = 'translation'), r AS (SELECT DISTINCT path FROM {SECTIONS} WHERE chapter_number IS NULL) SELECT 'not_in_manifest' AS kind, path FROM p WHERE path NOT IN (FROM q) UNION ALL SELECT 'missing_entry', path FROM q WHERE path NOT IN (FROM p) UNION ALL SELECT 'missing_reference', path FROM r WHERE path NOT IN (FROM q)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections_once(spark, sf_dir)
    of = lambda c: s.where(c).select("path").distinct()
    return match.orphans(of("edition = 'source'"), of("edition = 'translation'"), of("chapter_number IS NULL"), "path")


@query(f"SELECT book_id, section_index, section_id FROM {SECTIONS} WHERE edition = 'source' UNION ALL SELECT book_id, section_index, section_id FROM {SECTIONS} t WHERE edition = 'translation' AND NOT EXISTS (FROM sections s WHERE s.edition = 'source' AND s.book_id = t.book_id AND s.section_index = t.section_index)")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_index", "section_id") for d in editions(spark, sf_dir))
    return match.with_overrides(s, t, ["book_id", "section_index"])


@query(f"WITH m AS (SELECT book_id, chapter_number AS site_chapter, min(path) AS p FROM {SECTIONS} WHERE edition = 'source' GROUP BY ALL) SELECT DISTINCT c.chapter_id, coalesce(m.p, c.url) AS url FROM chapters c LEFT JOIN m ON c.book_id = m.book_id AND c.site_chapter = m.site_chapter")
def rewritten_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = editions(spark, sf_dir)
    mapping = s.groupBy("book_id", F.col("chapter_number").alias("site_chapter")).agg(F.min("path").alias("new_path"))
    return match.rewrite_links(table(spark, sf_dir, "chapters").select("chapter_id", "book_id", "site_chapter", "url"), mapping, ["book_id", "site_chapter"], "url").select("chapter_id", "url").distinct()


@query("SELECT DISTINCT chunk_id AS id FROM chunks WHERE attempt = 1 AND task = 'translate'")
def open_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    queue = c.select(F.col("chunk_id").alias("id"), F.when(F.col("attempt") == 1, "pending").otherwise("approved").alias("status"))
    return match.open_suggestions(queue, c.select(F.col("chunk_id").alias("id"), (F.col("task") == "translate").alias("applicable")), "id").select("id")


@query("""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY report_id DESC) AS n FROM (SELECT DISTINCT * FROM language_reports)) WHERE n = 1),
j AS (SELECT d.doc_id, CASE WHEN r.is_match THEN 0.9 WHEN r.report_id IS NOT NULL THEN 0.4 END AS c, CASE WHEN r.report_id IS NULL THEN NULL WHEN r.is_match IS NULL THEN 'doubtful' WHEN NOT r.is_match THEN 'rejected' ELSE 'ok' END AS s FROM documents d LEFT JOIN r USING (doc_id))
SELECT doc_id, concat_ws('; ', CASE WHEN c < 0.6 THEN 'low_confidence' END, CASE WHEN s = 'rejected' THEN 'rejected' END, CASE WHEN s = 'doubtful' THEN 'doubtful' END) AS reasons, CASE WHEN s = 'rejected' THEN 'FAIL' WHEN c < 0.6 OR s = 'doubtful' THEN 'WARN' ELSE 'OK' END AS verdict FROM j
""")
def reviewed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("is_match")
    reviews = table(spark, sf_dir, "language_reports").distinct().select("doc_id", "report_id", F.when(m, 0.9).otherwise(0.4).alias("confidence"), F.when(m.isNull(), "doubtful").when(~m, "rejected").otherwise("ok").alias("review_status"))
    return match.with_reviews(table(spark, sf_dir, "documents").select("doc_id"), reviews, ["doc_id"], "report_id").select("doc_id", "reasons", "verdict")


@query(f"WITH s AS (SELECT book_id, edition, max_by(title, section_id) FILTER (title IS NOT NULL) AS seen FROM {SECTIONS} GROUP BY ALL), b AS (SELECT book_id, min(title) AS t FROM books GROUP BY book_id) SELECT section_id, coalesce(CASE WHEN x.edition = 'source' THEN b.t END, s.seen) AS group_title FROM {SECTIONS} x LEFT JOIN s ON x.book_id = s.book_id AND x.edition = s.edition LEFT JOIN b ON x.book_id = b.book_id")
def group_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections_once(spark, sf_dir).select("section_id", "book_id", "edition", "title")
    base = table(spark, sf_dir, "books").groupBy("book_id").agg(F.min("title").alias("title")).withColumn("edition", F.lit("source"))
    return match.group_titles(rows, base, "book_id", "edition", "title", "section_id").select("section_id", "group_title")


@query(f"WITH a AS (SELECT book_id, section_id, row_number() OVER (PARTITION BY book_id ORDER BY section_id) AS n FROM {SECTIONS} WHERE edition = 'translation'), b AS (SELECT book_id, section_id AS canonical, row_number() OVER (PARTITION BY book_id ORDER BY section_id) AS n FROM {SECTIONS} WHERE edition = 'source') SELECT section_id, canonical FROM a LEFT JOIN b USING (book_id, n)")
def canonical_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_id") for d in editions(spark, sf_dir))
    return align.to_canonical(t, s, "book_id", "section_id", "section_id").select("section_id", "canonical")


FOLDED = compact(fold("array_to_string(paragraphs, ' ')"))


@query(f"""
WITH t AS (SELECT book_id, section_id, section_index, {FOLDED} AS t FROM {SECTIONS} WHERE edition = 'source'), w AS (SELECT *, string_split(t, ' ') AS p FROM t),
n AS (SELECT *, lag(t) OVER o AS b, lead(t) OVER o AS a FROM w WINDOW o AS (PARTITION BY book_id ORDER BY section_id))
SELECT section_id, coalesce(len(p) >= 8 AND contains(b, array_to_string(p[1:8], ' ')), false) AS first_in_previous, coalesce(len(p) >= 8 AND contains(a, array_to_string(p[greatest(len(p) - 7, 1):], ' ')), false) AS last_in_next FROM n
""")
def boundary_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = editions(spark, sf_dir)
    rows = s.select("book_id", "section_id", F.array_join("paragraphs", " ").alias("t"))
    return align.leaks(rows, "book_id", "section_id", "t").select("section_id", "first_in_previous", "last_in_next")


@query(f"""
WITH b AS {BOOKS}, s AS (SELECT source AS site, book_id, first_chapter AS f, last_chapter AS l, row_number() OVER (PARTITION BY source, first_chapter, last_chapter ORDER BY book_id) AS r FROM b WHERE source_lang = 'en'),
t AS (SELECT source AS site, book_id, first_chapter AS f, last_chapter AS l, row_number() OVER (PARTITION BY source, first_chapter, last_chapter ORDER BY book_id) AS r FROM b WHERE source_lang <> 'en'),
x AS (SELECT s.site, s.book_id AS source, t.book_id AS target FROM s JOIN t ON s.site = t.site AND s.f = t.f AND s.l = t.l AND s.r = t.r),
y AS (SELECT site, book_id, row_number() OVER (PARTITION BY site ORDER BY f NULLS LAST, book_id) AS n FROM s WHERE book_id NOT IN (SELECT source FROM x)), z AS (SELECT site, book_id, row_number() OVER (PARTITION BY site ORDER BY f NULLS LAST, book_id) AS n FROM t WHERE book_id NOT IN (SELECT target FROM x))
SELECT *, 'range' AS "by" FROM x UNION ALL SELECT y.site, y.book_id, z.book_id, 'position' FROM y JOIN z ON y.site = z.site AND y.n = z.n
""")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "books").distinct().withColumnRenamed("source", "site")
    return align.pair_files(b.where("source_lang = 'en'"), b.where("source_lang <> 'en'"), ["site"], "book_id", "first_chapter", "last_chapter")


# Roll-ups ----------------------------------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT book_id, coalesce(sum(char_count) FILTER (edition = 'source'), 0) AS a, coalesce(sum(char_count) FILTER (edition = 'translation'), 0) AS b FROM {SECTIONS} GROUP BY book_id) SELECT book_id, round(b / greatest(a, 1), 3) AS ratio, CASE WHEN a < 800 THEN NULL WHEN b / greatest(a, 1) < 0.55 THEN 'FAIL' WHEN b / greatest(a, 1) < 0.8 OR b / greatest(a, 1) > 1.65 THEN 'WARN' END AS verdict FROM t")
def ratio_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda e: F.coalesce(F.sum(F.when(F.col("edition") == e, F.col("char_count"))), F.lit(0))
    pairs = sections_once(spark, sf_dir).groupBy("book_id").agg(of("source").alias("a"), of("translation").alias("b"))
    return aggregate.ratio_checks(pairs, "a", "b", 0.55, 0.8, 1.65, 800).select("book_id", "ratio", "verdict")


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY book_id, edition ORDER BY section_index, section_id) AS rank FROM {SECTIONS} WHERE char_count > 0),
j AS (SELECT coalesce(s.book_id, t.book_id) AS book_id, s.char_count AS a, t.char_count AS b FROM (SELECT * FROM r WHERE edition = 'source') s FULL JOIN (SELECT * FROM r WHERE edition = 'translation') t ON s.book_id = t.book_id AND s.rank = t.rank)
SELECT book_id, round(greatest(0.0, least(1.0, 1 - sum(CASE WHEN b IS NULL THEN 0.15 WHEN b / a < 0.35 THEN 0.1 WHEN b / a < 0.55 THEN 0.05 ELSE 0.0 END))), 6) AS score FROM j GROUP BY book_id
""")
def structural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_id", "section_index", "char_count") for d in editions(spark, sf_dir))
    both = align.by_position(s, t, "book_id", ["section_index", "section_id"], "char_count")
    r = F.col("target_char_count") / F.col("source_char_count")
    return aggregate.structural_score(both, ["book_id"], F.col("match_type") == "missing", r < 0.35, r < 0.55)


CATEGORIES = ["straight_quotes", "double_spaces", "no_such_finding", "other"]


@query(f"WITH f AS (SELECT CASE WHEN type IN ('straight_quotes', 'double_spaces') THEN type ELSE 'other' END AS category FROM ({RULE_SQL})), c(category) AS (VALUES {', '.join(f'({c!r})' for c in CATEGORIES)}) SELECT c.category, count(f.category) AS n FROM c LEFT JOIN f ON c.category = f.category GROUP BY c.category")
def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.by_rules(table(spark, sf_dir, "documents"), "doc_id", "text", detect.MARKUP + detect.PUNCTUATION + detect.STYLE).withColumn("category", F.col("type"))
    return aggregate.by_category(found, spark.createDataFrame([(c,) for c in CATEGORIES], "category string"), "other").select("category", "n")


ALIASES = "(SELECT canonical, unnest(aliases).from_text AS alias, unnest(aliases).to_text AS example, 1 AS count FROM (SELECT DISTINCT * FROM entities))"


def alias_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").distinct().select("canonical", F.explode("aliases").alias("x")).select("canonical", F.col("x.from_text").alias("alias"), F.col("x.to_text").alias("example"), F.lit(1).alias("count"))


@query(f"WITH a AS {ALIASES} SELECT canonical, alias, count(*) AS count, array_to_string(list_sort(list(DISTINCT example) FILTER (example IS NOT NULL))[1:5], '|') AS examples FROM a GROUP BY canonical, alias")
def alias_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.alias_roll_up(alias_changes(spark, sf_dir)).withColumn("examples", F.array_join("examples", "|"))


@query(f"WITH a AS {ALIASES} SELECT alias, example, count(*) AS count FROM a GROUP BY alias, example")
def merged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.merge_changes(alias_changes(spark, sf_dir), ["alias", "example"])


@query("SELECT source, sum(n_chars) AS n_chars FROM documents GROUP BY ROLLUP (source)")
def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.roll_up(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT from_lang, count(*) AS n, min(confidence) AS least, round(avg(confidence), 6) AS mean, max(confidence) AS most FROM terms WHERE NOT isnan(confidence) GROUP BY from_lang")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.confidence_summary(table(spark, sf_dir, "terms").where("NOT isnan(confidence) AND confidence IS NOT NULL"), ["from_lang"], "confidence")


@query("SELECT task, CASE WHEN output_text IS NULL THEN 'failed' WHEN length(output_text) > 20 THEN 'applied' ELSE 'skipped' END AS batch_status, count(*) AS n FROM chunks GROUP BY 1, 2")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").withColumn("error", F.when(F.col("output_text").isNull(), "no output"))
    return state.batch_status(c, F.length("output_text") > 20, ["task"])


@query(f"SELECT book_id, concat_ws('; ', CASE WHEN author IS NULL THEN 'no_author' END, CASE WHEN publisher IS NULL THEN 'no_publisher' END, CASE WHEN first_chapter > last_chapter THEN 'inverted' END) AS reasons FROM {BOOKS} WHERE author IS NULL OR publisher IS NULL OR first_chapter > last_chapter")
def problem_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"no_author": F.col("author").isNull(), "no_publisher": F.col("publisher").isNull(), "inverted": F.col("first_chapter") > F.col("last_chapter")}
    return aggregate.reasons(table(spark, sf_dir, "books").distinct(), checks).select("book_id", "reasons")


@query(f"WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS unit, type, CASE severity WHEN 'FAIL' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END AS w FROM ({RULE_SQL})) SELECT unit, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, CASE min(w) WHEN 0 THEN 'PROBLEM' WHEN 1 THEN 'ATTENTION' ELSE 'OK' END AS label FROM f GROUP BY unit")
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.report_label(rule_findings(spark, sf_dir), ["unit"]).withColumn("types", F.array_join("types", ","))


@query("SELECT * FROM (SELECT unnest(['all_have_books', 'all_have_text', 'positive_sizes']) AS \"check\", unnest([(SELECT bool_and(book_id IS NOT NULL) FROM sections), (SELECT bool_and(len(paragraphs) > 0) FROM sections), (SELECT bool_and(char_count >= 0) FROM sections)]) AS passed)")
def named_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "sections").agg(F.bool_and(F.col("book_id").isNotNull()).alias("a"), F.bool_and(F.size("paragraphs") > 0).alias("b"), F.bool_and(F.col("char_count") >= 0).alias("c"))
    return aggregate.named_checks(one, {"all_have_books": F.col("a"), "all_have_text": F.col("b"), "positive_sizes": F.col("c")})


@query("WITH a AS (SELECT source, count(*) AS n FROM (SELECT DISTINCT * FROM books) GROUP BY source), b AS (SELECT source, count(DISTINCT book_id) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT coalesce(a.source, b.source) AS source, a.n AS approved, b.n AS actual, a.n IS NOT DISTINCT FROM b.n AS passed FROM a FULL JOIN b ON a.source = b.source")
def against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "books").distinct().groupBy("source").agg(F.count("*").alias("n"))
    return aggregate.against_baseline(table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count_distinct("book_id").alias("n")), a, "source", "n")


@query("SELECT source, count(*) AS chapters, round(1000 * count(lang) / count(*), 3) + least(count(*), 999) + 10 - 100 * count(*) FILTER (text IS NULL) AS score FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY score DESC, chapters DESC, source LIMIT 5")
def best_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("chapters"), (F.count("lang") / F.count("*")).alias("coverage"), F.count_if(F.col("text").isNull()).alias("conflicts"))
    scored = aggregate.source_score(rows.withColumn("duplicates", F.lit(0)).withColumn("out_of_order", F.lit(0)).withColumn("priority", F.lit(1)))
    return findings.best_source(scored, 5).select("source", "chapters", "score")


@query("SELECT source, (SELECT max(CASE WHEN a[1:i] = b[1:i] THEN trim(a[1:i]) END) FROM unnest(range(0, length(a) + 1)) t(i)) AS prefix FROM (SELECT source, min(title) AS a, max(title) AS b FROM books WHERE title IS NOT NULL GROUP BY source)")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.common_prefix(table(spark, sf_dir, "books"), ["source"], "title")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'signup')")
def last_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.last_run(table(spark, sf_dir, "events"), "ts", "event_type", "signup").select("event_id")


# Sets and findings -------------------------------------------------------------------------------------------------------


def _key(x: str) -> str:
    return f"coalesce(nullif(trim({x}), ''), '-')"


@query(f"SELECT term_id, {_key('from_text')} || '::' || {_key('to_text')} AS stable, {_key(comparable('from_text'))} || '::' || {_key(comparable('to_text'))} AS dedupe FROM terms")
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "terms").select("term_id", findings.stable_key(F.col("from_text"), F.col("to_text")).alias("stable"), findings.dedupe_key(F.col("from_text"), F.col("to_text")).alias("dedupe"))


@query(f"WITH s AS {SECTIONS}, b AS (SELECT section_id, 'best' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY book_id, edition, chapter_number ORDER BY section_index, section_id) AS r FROM s) WHERE r = 1), c AS (SELECT book_id, edition, chapter_number, count(DISTINCT title) AS n FROM s GROUP BY ALL HAVING count(DISTINCT title) > 1) SELECT (SELECT count(*) FROM b) AS best, (SELECT count(*) FROM c) AS conflicts")
def candidate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, conflict = findings.dedupe_candidates(sections_once(spark, sf_dir), ["book_id", "edition"], "chapter_number", F.col("title"), ["section_index", "section_id"])
    return best.agg(F.count("*").alias("best")).join(conflict.agg(F.count("*").alias("conflicts")))


@query("SELECT canonical, count(*) AS n, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS ids FROM entities GROUP BY canonical")
def distinct_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.distinct_with_ids(table(spark, sf_dir, "entities"), ["canonical"], "entity_id").withColumn("ids", F.array_join("ids", ","))


@query(f"WITH k AS (SELECT book_id || '-' || section_index AS key, edition, sha256(array_to_string(paragraphs, ' ')) AS d FROM (SELECT *, row_number() OVER (PARTITION BY book_id, edition, section_index ORDER BY section_id) AS r FROM {SECTIONS}) WHERE r = 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM k WHERE edition = 'source') a FULL JOIN (SELECT * FROM k WHERE edition = 'translation') b ON a.key = b.key WHERE a.d IS DISTINCT FROM b.d")
def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (windows.keep_first(d, ["book_id", "section_index"], ["section_id"]).select(F.concat_ws("-", "book_id", "section_index").alias("key"), F.array_join("paragraphs", " ").alias("c")) for d in editions(spark, sf_dir))
    return findings.content_diff(s, t, "key", "c")


PHRASES = ["the river", "the", "of the", "por la noche", "la noche", "o rio"]
FOUND = f"list_filter([{', '.join(map(repr, PHRASES))}], lambda m: contains(' ' || {comparable('text')} || ' ', ' ' || m || ' '))"


@query(f"WITH f AS (SELECT doc_id, {FOUND} AS f FROM documents), l AS (SELECT doc_id, list_filter(f, lambda p: len(list_filter(f, lambda q: length(q) > length(p) AND contains(q, p))) = 0) AS p FROM f) SELECT CAST(doc_id AS VARCHAR) AS unit, len(p) AS occurrences, array_to_string(p, ',') AS detail FROM l WHERE len(p) > 0")
def residual_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.foreign_terms(table(spark, sf_dir, "documents"), "doc_id", "text", PHRASES).select("unit", "occurrences", "detail")


# Detectors ---------------------------------------------------------------------------------------------------------------


def _marked(lang: str) -> str:
    return rf"len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda w: w IN ({', '.join(map(repr, detect.MARKERS[lang]))})))"


@query(f"SELECT DISTINCT CAST(doc_id AS VARCHAR) AS unit, {_marked('en')} AS occurrences FROM documents WHERE length(text) >= 120 AND {_marked('en')} >= 8 AND {_marked('en')} > {_marked('pt')}")
def residual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.residual_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", "en", "pt").select("unit", "occurrences")


QUOTED = "array_to_string(regexp_extract_all(coalesce(text, ''), '[\"“«][^\"”»]{8,}[\"”»]'), ' ')"


@query(rf"WITH q AS (SELECT doc_id, {fold(QUOTED)} AS q FROM documents), k AS (SELECT doc_id, CASE WHEN regexp_matches(q, '{detect.INFORMAL}') AND regexp_matches(q, '{detect.FAMILIAR}') THEN 'informal and familiar' WHEN regexp_matches(q, '{detect.INFORMAL}') AND regexp_matches(q, '{detect.FORMAL}') THEN 'informal and formal' END AS k FROM q) SELECT CAST(doc_id AS VARCHAR) AS unit, k AS detail FROM k WHERE k IS NOT NULL")
def treatment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.treatment_findings(table(spark, sf_dir, "documents"), "doc_id", "text").select("unit", "detail")


@query(HITS.replace("WHERE trim(coalesce(from_text, '')) <> ''", "WHERE trim(coalesce(from_text, '')) <> '' AND to_text IS NOT NULL") + """, h AS (SELECT doc_id, term, count(*) AS hits FROM a JOIN g ON word = parts[1] AND list_slice(words, i, i + len(parts) - 1) = parts GROUP BY doc_id, term),
k AS (SELECT from_text AS term, min(term_id) AS term_id, max(CASE WHEN NOT isnan(confidence) THEN confidence END) AS c FROM terms WHERE from_text IS NOT NULL AND to_text IS NOT NULL GROUP BY from_text),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY term_id) AS r FROM h JOIN k USING (term)) SELECT CAST(doc_id AS VARCHAR) AS unit, CASE WHEN c >= 0.9 THEN 'medium' ELSE 'low' END AS severity, hits AS occurrences, term AS detail FROM r WHERE r = 1""")
def first_old_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.terminology_findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "terms"), "doc_id", "text").drop("type")


@query(r"WITH a AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda w: regexp_full_match(w, '[A-Z]{2,6}')))) AS a FROM documents) SELECT CAST(doc_id AS VARCHAR) AS unit, len(a) AS occurrences, array_to_string(a, ',') AS detail FROM a WHERE len(a) > 0")
def acronym_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.acronyms(table(spark, sf_dir, "documents"), "doc_id", "text").select("unit", "occurrences", "detail")


NAME_SQL = r"list_distinct(regexp_extract_all(coalesce({}, ''), '(?:^|[^\p{{L}}\p{{N}}])(\p{{Lu}}[\p{{L}}\p{{N}}''-]{{2,}})', 1))"
ORDERED = r"list_filter(regexp_extract_all({}, '(?:^|[^\p{{L}}\p{{N}}])(\p{{Lu}}[\p{{L}}\p{{N}}''-]{{2,}})', 1), lambda x, i: list_position(regexp_extract_all({}, '(?:^|[^\p{{L}}\p{{N}}])(\p{{Lu}}[\p{{L}}\p{{N}}''-]{{2,}})', 1), x) = i AND x NOT IN (" + ", ".join(repr(w) for w in text.NO_NAMES) + "))"
TOLD = r"list_filter(list_transform(regexp_extract_all({}, '\d[\d.,]*'), lambda x: regexp_replace(x, '[.,]', '', 'g')), lambda x: length(x) > 1)"
LOST = f"list_sort(list_distinct(list_filter({TOLD.format('a')}, lambda x: NOT list_contains({TOLD.format('b')}, x))))"
LEN_A, LEN_B = f"length({compact('a')})", f"length({compact('b')})"


@query(PAIRED + f""", r AS (SELECT *, {LEN_B} / {LEN_A} AS ratio FROM p WHERE {LEN_A} > 0 AND {LEN_B} > 0), g AS (SELECT unit, len(list_filter(({ORDERED.format('a', 'a')})[1:8], lambda x: NOT contains({comparable('b')}, {comparable('x')}))) AS n FROM p)
SELECT unit, 'omission_or_expansion' AS type, CASE WHEN ratio < 0.42 OR ratio > 2.7 THEN 'high' ELSE 'medium' END AS severity, 1 AS occurrences FROM r WHERE ratio < 0.58 OR ratio > 2.1
UNION ALL SELECT unit, 'number_missing', 'high', len({LOST}) FROM p WHERE len({LOST}) > 0 UNION ALL SELECT unit, 'entity_drift', 'medium', n FROM g WHERE n >= 2
UNION ALL SELECT unit, 'dialogue_punctuation_drift', 'low', 1 FROM p WHERE regexp_matches(coalesce(a, ''), '[?？]') <> regexp_matches(coalesce(b, ''), '[?？]') OR regexp_matches(coalesce(a, ''), '[!！]') <> regexp_matches(coalesce(b, ''), '[!！]')""")
def pair_finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pair_findings(paired_sections(spark, sf_dir), "unit", "a", "b").drop("detail")


@query(PAIRED_FULL + f""", n AS (SELECT unit, len(list_filter({ORDERED.format('a', 'a')}, lambda x: NOT contains({comparable('b')}, {comparable('x')}))) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT unit, 'chapter_missing' AS type, 1 AS occurrences FROM p WHERE b IS NULL AND a IS NOT NULL UNION ALL SELECT unit, 'chapter_short', 1 FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND {LEN_A} > 3000 AND {LEN_B} / greatest({LEN_A}, 1) < 0.45
UNION ALL SELECT unit, 'numbers_missing', len({LOST}) FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND len({LOST}) > 0 UNION ALL SELECT unit, 'names_missing', n FROM n WHERE n >= 4""")
def coverage_finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.coverage_findings(paired_sections(spark, sf_dir, "full"), "unit", "a", "b").select("unit", "type", "occurrences")


RARE_SQL = rf"""
WITH w AS (SELECT book_id, section_id, edition, unnest(regexp_extract_all(array_to_string(paragraphs, ' '), '{WORDS}')) AS w FROM {SECTIONS}), c AS (SELECT *, regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS token FROM w),
s AS (SELECT book_id, token, count(*) AS n, bool_or(regexp_matches(w, '^\p{{Lu}}')) AS name FROM c WHERE edition = 'source' AND length(token) >= 4 GROUP BY ALL), t AS (SELECT book_id, token, count(*) AS n FROM c WHERE edition = 'translation' AND length(token) >= 4 GROUP BY ALL),
k AS (SELECT s.book_id, s.token, s.token IN ('with', 'that', 'from') AS m FROM s JOIN t ON s.book_id = t.book_id AND s.token = t.token WHERE s.token NOT IN ('para', 'como') AND (s.token IN ('with', 'that', 'from') OR NOT s.name AND s.n <= 25 AND t.n <= 12))
SELECT CAST(section_id AS VARCHAR) AS unit, CASE WHEN bool_or(m) THEN 'high' ELSE 'medium' END AS severity, count(DISTINCT token) AS occurrences, array_to_string(list_sort(list(DISTINCT token)), ',') AS detail FROM c JOIN k USING (book_id, token) WHERE edition = 'translation' AND length(token) >= 4 GROUP BY section_id
"""


@query(RARE_SQL)
def residual_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_id", F.array_join("paragraphs", " ").alias("t")) for d in editions(spark, sf_dir))
    return detect.residual_vocabulary(s, t, ["book_id"], "section_id", "t", ["with", "that", "from"], ["para", "como"]).drop("type")


@query(rf"""
WITH g AS (SELECT DISTINCT from_text AS term, regexp_extract_all(strip_accents(lower(from_text)), '[\p{{L}}\p{{N}}]+') AS parts FROM terms WHERE trim(coalesce(from_text, '')) <> ''),
x AS (SELECT book_id, section_id, section_index, edition, regexp_extract_all({fold("array_to_string(paragraphs, ' ')")}, '[\p{{L}}\p{{N}}]+') AS words FROM {SECTIONS}), a AS (SELECT *, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM x),
h AS (SELECT book_id, section_id, section_index, edition, term, count(*) AS hits FROM a JOIN g ON word = parts[1] AND list_slice(words, i, i + len(parts) - 1) = parts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id, term ORDER BY section_index, section_id) AS r FROM h t WHERE edition = 'translation' AND EXISTS (FROM h s WHERE s.edition = 'source' AND s.book_id = t.book_id AND s.term = t.term))
SELECT CAST(section_id AS VARCHAR) AS unit, hits AS occurrences, term AS detail FROM r WHERE r <= 6
""")
def terms_in_both_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_id", "section_index", F.array_join("paragraphs", " ").alias("t")) for d in editions(spark, sf_dir))
    return detect.terms_in_both(s, t, table(spark, sf_dir, "terms"), ["book_id"], "section_id", "section_index", "t").select("unit", "occurrences", "detail")


STRUCTURE = f"""
WITH s AS (SELECT book_id, count(*) AS html_items, count(*) FILTER (path IS NOT NULL) AS spine_items, count(DISTINCT chapter_number) AS chapters, max(chapter_number) - min(chapter_number) + 1 - count(DISTINCT chapter_number) AS missing, count(*) FILTER (title IS NULL) AS invalid, min(lang_code) FILTER (edition = 'source') AS lang FROM {SECTIONS} GROUP BY book_id),
b AS (SELECT book_id, max(source_lang) AS source_lang, max(last_chapter) AS last_chapter FROM books GROUP BY book_id), j AS (SELECT * FROM b LEFT JOIN s USING (book_id))
"""


@query(STRUCTURE + " UNION ALL ".join(f"SELECT CAST(book_id AS VARCHAR) AS unit, '{c}' AS code, '{level}' AS level FROM j WHERE {w}" for c, level, w in (("NO_HTML", "error", "coalesce(html_items, 0) = 0"), ("NO_SPINE", "error", "coalesce(spine_items, 0) = 0"), ("NO_CHAPTERS", "error", "coalesce(chapters, 0) = 0"), ("NO_NCX_SOURCE", "warning", "last_chapter IS NULL"), ("LANGUAGE_MISMATCH", "warning", "coalesce(source_lang, '') <> coalesce(lang, '')"), ("MISSING_CHAPTERS", "error", "missing > 0"), ("INVALID_TITLES", "warning", "invalid > 0"))))
def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("chapter_number")
    s = sections_once(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("html_items"), F.count("path").alias("spine_items"), F.count_distinct(n).alias("chapters"), (F.max(n) - F.min(n) + 1 - F.count_distinct(n)).alias("missing_chapters"), F.count_if(F.col("title").isNull()).alias("invalid_titles"), F.min(F.when(F.col("edition") == "source", F.col("lang_code"))).alias("detected_language"))
    b = table(spark, sf_dir, "books").groupBy("book_id").agg(F.max("source_lang").alias("metadata_language"), F.max("last_chapter").isNotNull().alias("has_ncx"))
    none = {c: F.lit(0) for c in ("expected_chapters", "broken", "suspicious_titles")}
    return detect.structure_findings(b.join(s, "book_id", "left").withColumns({**none, "opf_path": F.lit("book.opf"), "canonical": F.lit(False)}), "book_id")


# Corrections and states --------------------------------------------------------------------------------------------------

STEPS = ["text", r"regexp_replace(text, ' {2,}', ' ', 'g')", r"regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')"]


@query(" UNION ALL ".join(rf"SELECT doc_id, {i} AS rule, len(regexp_extract_all({t}, '{p}')) AS hits FROM documents WHERE len(regexp_extract_all({t}, '{p}')) > 0" for i, (t, p) in enumerate(zip(STEPS, (r" {2,}", r"\s+([,.;:!?])", r"\.{3}")))))
def counted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.count_rules(table(spark, sf_dir, "documents"), ["doc_id"], "text", FIX[:3]).select("doc_id", "rule", F.col("hits").cast("bigint").alias("hits"))


@query("""
WITH a AS (SELECT 'log' AS origin, from_text, to_text, 0.98 AS confidence FROM (SELECT unnest(aliases).from_text AS from_text, unnest(aliases).to_text AS to_text FROM (SELECT DISTINCT * FROM entities))
  UNION ALL SELECT 'glossary', from_text, to_text, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.7 ELSE confidence END FROM terms UNION ALL SELECT 'finding', title, NULL, CASE WHEN chapter_number IS NULL THEN 0.65 ELSE 0.0 END FROM (SELECT DISTINCT ON (section_id) * FROM sections)),
m AS (SELECT *, CASE WHEN origin <> 'finding' AND confidence >= 0.9 AND to_text IS NOT NULL THEN 'auto_safe' WHEN confidence >= 0.5 THEN 'auto_review' ELSE 'manual_only' END AS mode FROM a WHERE from_text IS NOT NULL)
SELECT origin, mode, CASE WHEN mode = 'auto_safe' THEN 'ready' ELSE 'pending' END AS status, CASE mode WHEN 'auto_safe' THEN 'low' WHEN 'auto_review' THEN 'medium' ELSE 'high' END AS risk, count(*) AS n FROM m GROUP BY ALL
""")
def correction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "entities").distinct().select(F.explode("aliases").alias("x")).select("x.from_text", "x.to_text")
    found = sections_once(spark, sf_dir).select(F.col("title").alias("from_text"), F.lit(None).cast("string").alias("to_text"), F.when(F.col("chapter_number").isNull(), "FAIL").otherwise("INFO").alias("severity"))
    return correct.plan(correct.candidates(log, table(spark, sf_dir, "terms"), found)).groupBy("origin", "mode", "status", "risk").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT entity_id, coalesce(nullif(CASE WHEN trim(note) <> '' THEN note END, ''), CASE WHEN trim(original_name) <> '' THEN original_name END, CASE WHEN trim(canonical) <> '' THEN canonical END) AS from_text FROM entities")
def reviewed_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").select("entity_id", *[F.col(s).alias(f"{p}_{x}") for x in ("from", "to") for p, s in (("reviewed", "note"), ("title", "original_name"), ("term", "canonical"))])
    return correct.reviewed_replacement(e).select("entity_id", "from_text").distinct()


@query("SELECT term_id, CASE WHEN confidence >= 0.9 AND NOT isnan(confidence) THEN 1 ELSE 0 END AS replacements_applied, CASE WHEN confidence >= 0.9 AND NOT isnan(confidence) THEN 'applied' ELSE apply_mode END AS status FROM terms")
def applied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "terms")
    done = t.where("confidence >= 0.9 AND NOT isnan(confidence)").select("term_id", F.lit(1).alias("replacements"))
    return correct.mark_applied(t.select("term_id", F.col("apply_mode").alias("status")), done, "term_id")


@query("SELECT term_id, CASE apply_mode WHEN 'auto_safe' THEN 'approved' WHEN 'auto_review' THEN 'needs_context' WHEN 'manual_only' THEN 'rejected' ELSE 'pending' END AS status, to_text AS after FROM terms")
def decided_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("apply_mode")
    t = table(spark, sf_dir, "terms").select("term_id", F.when(m == "auto_safe", "apply").when(m == "auto_review", "ask").when(m == "manual_only", "keep").alias("decision"), F.lit("pending").alias("status"), F.col("to_text").alias("after"), F.lit(None).cast("string").alias("edited"))
    return correct.decide(t).select("term_id", "status", "after")


@query(f"WITH s AS (SELECT DISTINCT book_id, section_index, edition FROM {SECTIONS}) SELECT book_id, section_index, CASE edition WHEN 'source' THEN 'MISSING' ELSE 'UNEXPECTED' END AS code FROM s a WHERE NOT EXISTS (FROM s b WHERE b.book_id = a.book_id AND b.section_index = a.section_index AND b.edition <> a.edition)")
def merged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_index").distinct() for d in editions(spark, sf_dir))
    return correct.merged_errors(s, t, "book_id", "section_index")


def _signal(ws: list[str]) -> str:
    return rf"len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: w IN ({', '.join(map(repr, ws))})))"


@query(f"SELECT DISTINCT node_id, CASE WHEN {_signal(['he', 'his'])} > 0 AND {_signal(['she', 'her'])} = 0 THEN 'male' WHEN {_signal(['she', 'her'])} > 0 AND {_signal(['he', 'his'])} = 0 THEN 'female' ELSE 'unknown' END AS signal FROM text_nodes WHERE text IS NOT NULL")
def gender_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_nodes").where("text IS NOT NULL").select("node_id", correct.gender_signal(F.col("text"), ["he", "his"], ["she", "her"]).alias("signal")).distinct()


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    manifest = table(spark, sf_dir, "books").groupBy(F.col("book_id").alias("version")).agg(F.min("title").alias("output"))
    return manifest, table(spark, sf_dir, "documents").select(F.col("book_id").alias("version")).where("version IS NOT NULL").distinct()


MANIFEST = "WITH m AS (SELECT book_id AS version, min(title) AS output FROM books GROUP BY book_id), p AS (SELECT DISTINCT book_id AS version FROM documents WHERE book_id IS NOT NULL)"


@query(MANIFEST + " SELECT coalesce(m.version, p.version) AS version, CASE WHEN p.version IS NULL THEN 'missing' WHEN m.version IS NULL THEN 'unregistered' ELSE 'known' END AS state FROM m FULL JOIN p ON m.version = p.version")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reconcile(*versions(spark, sf_dir)).select("version", "state")


@query(MANIFEST + ", k AS (SELECT * FROM m WHERE version IN (FROM p)) SELECT version, output, version = (SELECT max(version) FROM k) AS current FROM k")
def sanitized_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sanitize(*versions(spark, sf_dir)).select("version", "output", "current")


@query(MANIFEST + " SELECT output AS input FROM m ORDER BY version DESC LIMIT 1")
def working_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.working_input(versions(spark, sf_dir)[0], "original.epub")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM language_reports WHERE doc_id IS NOT NULL)")
def resumed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.only_new(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_reports").select("doc_id").distinct(), ["doc_id"]).select("doc_id")


@query("(SELECT event_type, ts FROM events WHERE event_type = 'signup' ORDER BY ts DESC LIMIT 5) UNION ALL (SELECT event_type, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC LIMIT 20)")
def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.log_view(table(spark, sf_dir, "events"), "ts", "event_type", "signup", "purchase").select("event_type", "ts")


EXPRESSIONS = [{"pattern": r"\bold man\b", "problem": "cliché", "suggestion": "elder"}, {"pattern": r"\briver\b", "problem": "place", "suggestion": None}]


@query("SELECT DISTINCT node_id, 'cliché' AS problem, 'elder' AS suggestion FROM text_nodes WHERE regexp_matches(text, '(?i)\\bold man\\b') UNION ALL SELECT DISTINCT node_id, 'place', NULL FROM text_nodes WHERE regexp_matches(text, '(?i)\\briver\\b')")
def expression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.expression_rules(table(spark, sf_dir, "text_nodes"), ["node_id"], "text", EXPRESSIONS).distinct()


@query("SELECT DISTINCT chunk_id, md5(instruction || chr(10) || chr(10) || 'Language: ' || coalesce(target_lang, '-') || chr(10) || chr(10) || output_text) AS digest FROM chunks WHERE instruction IS NOT NULL AND output_text IS NOT NULL")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("instruction IS NOT NULL AND output_text IS NOT NULL")
    return models.prompts(c, F.col("instruction"), F.col("output_text"), F.col("target_lang")).select("chunk_id", F.md5("prompt").alias("digest")).distinct()


ITEM = "trim(coalesce({}, '')) = ''"


@query("WITH e AS (SELECT DISTINCT entity_id, entity_role AS status, canonical AS before, original_name AS after, note AS location FROM entities) " + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS code, '{level}' AS level FROM e WHERE {w}" for c, level, w in (("status_invalid", "error", "coalesce(status, '') NOT IN ('pending', 'approved', 'rejected', 'needs_context')"), ("before_missing", "error", ITEM.format("before")), ("after_missing", "error", ITEM.format("after")), ("no_change", "warning", "before = after"), ("location_missing", "warning", ITEM.format("location")))))
def queue_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").select("entity_id", F.col("entity_role").alias("status"), F.col("canonical").alias("before"), F.col("original_name").alias("after"), F.col("note").alias("location")).distinct()
    return validate.queue_errors(e, "entity_id")


@query(f"SELECT section_id FROM {SECTIONS} WHERE char_count >= 5000 OR title LIKE 'Chapter%'")
def small_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.small_items(sections_once(spark, sf_dir), "char_count", F.coalesce(F.col("title").like("Chapter%"), F.lit(False))).select("section_id")


@query("SELECT term_id, CASE WHEN apply_mode = 'auto_safe' THEN 'high' WHEN apply_mode = 'auto_review' THEN 'medium' ELSE 'low' END AS impact, CASE WHEN apply_mode = 'auto_safe' THEN 'review first' ELSE 'review' END AS next_action FROM terms")
def item_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("apply_mode")
    t = table(spark, sf_dir, "terms").select("term_id", F.when(m == "auto_safe", "FAIL").when(m == "auto_review", "WARN").otherwise("INFO").alias("severity"), F.lit("pending").alias("status"))
    return findings.impact(t).select("term_id", "impact", "next_action")
