"""Named queries over the project tables, and the SQL that a second engine runs for each.

Every query reads whole tables. Where SQL cannot express a query it has none and is tested against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import headings, model_text, similarity, text
from folioscope.operators import aggregate, align, correct, detect, findings, match, segment, windows
from folioscope.plans import pipelines
from folioscope.session import table
from folioscope.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORDS = r"[\p{L}\p{N}][\p{L}\p{N}''’-]*"
LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, '\n') AS l FROM documents WHERE text IS NOT NULL)"
MARKERS = ", ".join(f"('{w}', '{lang}')" for lang, ws in detect.MARKERS.items() for w in ws)
RULES = detect.MARKUP + detect.PUNCTUATION + detect.STYLE


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def editions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "sections").dropDuplicates(["section_id"])
    return s.where("edition = 'source'"), s.where("edition = 'translation'")


SECTIONS = "(SELECT DISTINCT ON (section_id) * FROM sections)"


# Profiles, tokens, vocabulary --------------------------------------------------------------------------------------------


@query(r"""
WITH pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?;:\n]+')) AS piece FROM documents WHERE text IS NOT NULL),
long AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(piece), '[^\p{L}\p{N}\s]', '', 'g'), '[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS line FROM pieces WHERE length(trim(piece)) > 20),
counted AS (SELECT doc_id, line, count(*) AS n FROM long GROUP BY doc_id, line),
rolled AS (SELECT doc_id, sum(n) AS pieces, coalesce(sum(CASE WHEN n > 1 AND length(line) > 20 THEN n END), 0) AS repeated FROM counted GROUP BY doc_id)
SELECT doc_id, CAST(pieces AS BIGINT) AS pieces, CAST(repeated AS BIGINT) AS repeated,
       CASE WHEN repeated / pieces > 0.15 THEN 'FAIL' WHEN repeated / pieces > 0.05 THEN 'WARN' ELSE 'OK' END AS verdict FROM rolled
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.repetition(table(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", "pieces", "repeated", "verdict")


@query(r"""
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
       CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(replace(x, chr(13), '')) <> '')), 0) AS BIGINT) AS lines, md5(coalesce(text, '')) AS digest
FROM documents
""")
def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.text_or_empty(F.col("text"))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))) != ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), F.octet_length(t).cast("bigint").alias("bytes"), lines.cast("bigint").alias("lines"), F.md5(t).alias("digest"))


@query(rf"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS token FROM documents) GROUP BY token")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.word_frequency(table(spark, sf_dir, "documents"), "text")


STOP = ["with", "that", "para", "pour", "dans", "como"]


@query(rf"""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS token FROM documents)
WHERE length(token) >= 4 AND token NOT IN ({", ".join(repr(w) for w in STOP)}) GROUP BY token HAVING count(*) BETWEEN 2 AND 80
""")
def vocabulary_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.vocabulary(table(spark, sf_dir, "documents"), "text", STOP)


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]{3,}')) AS token FROM text_nodes) GROUP BY token")
def accent_fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_nodes").select(F.explode(F.regexp_extract_all(text.fold(F.col("text")), F.lit("[a-z0-9]{3,}"), 0)).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\d+(?:[.,]\d+)?'))), ' ') AS numbers FROM documents WHERE text IS NOT NULL")
def numbers_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(text.numbers(F.col("text"))), " ").alias("numbers"))


@query(rf"""
WITH n AS (SELECT book_id, node_id, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}])(\p{{Lu}}[\p{{L}}\p{{N}}''-]{{2,}})', 1))) AS name FROM text_nodes)
SELECT book_id, name, count(*) AS n FROM n WHERE name NOT IN ({", ".join(repr(w) for w in text.NO_NAMES)}) GROUP BY book_id, name HAVING count(*) >= 2
""")
def proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.named_entities(table(spark, sf_dir, "text_nodes"), ["book_id"], "text", "node_id").select("book_id", "name", "n")


@query(rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS token FROM documents), lexicon(token, lang) AS (VALUES {MARKERS}),
total AS (SELECT doc_id, count(*) AS words FROM words GROUP BY doc_id),
score AS (SELECT doc_id, lang, round(count(*) / any_value(words), 6) AS score FROM words JOIN lexicon USING (token) JOIN total USING (doc_id) GROUP BY doc_id, lang)
SELECT doc_id, lang, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM score) WHERE r = 1
""")
def language_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame([(w, lang, False) for lang, ws in detect.MARKERS.items() for w in ws], "token string, lang string, strong boolean")
    return aggregate.dominant(aggregate.word_language(table(spark, sf_dir, "documents"), ["doc_id"], "text", lexicon), ["doc_id"])


@query(r"SELECT metadata_language, CASE WHEN regexp_matches(lower(trim(metadata_language)), '^[a-z]') THEN regexp_extract(lower(trim(metadata_language)), '^([a-z]+)', 1) END AS base, count(*) AS n FROM language_reports GROUP BY 1, 2")
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "language_reports").groupBy("metadata_language", text.language_base(F.col("metadata_language")).alias("base")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT path, format('id{:05d}', CAST(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(path, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: (a * 33 + x) % 4294967296) % 100000 AS BIGINT)) AS id FROM sections")
def djb2_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sections").select("path").distinct().select("path", text.display_id(F.col("path")).alias("id"))


# Headings and titles -----------------------------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT DISTINCT title AS raw, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title FROM sections WHERE title IS NOT NULL),
p AS (SELECT raw, regexp_extract(title, '(?i)^(cap[ií]tulo|chapter|chapitre|cap\.)\s+(\d{1,4})(?:\s*[.:—–-]\s*|\s+)(.+)$', ['w', 'n', 't']) AS e, regexp_extract(title, '^(\d{1,4})[.)]\s+(.+)$', ['n', 't']) AS m FROM t)
SELECT raw AS title, coalesce(TRY_CAST(e.n AS INT), TRY_CAST(m.n AS INT)) AS number, CASE WHEN e.n <> '' THEN trim(e.t) WHEN m.n <> '' THEN trim(m.t) END AS name,
       CASE WHEN e.n <> '' THEN 'explicit-prefix' WHEN m.n <> '' THEN 'numbered-punctuation' END AS format FROM p
""")
def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headings.parse_heading(F.col("title"))
    rows = table(spark, sf_dir, "sections").where("title IS NOT NULL").select("title").distinct().withColumn("h", h)
    return rows.select("title", F.col("h.number").alias("number"), F.col("h.title").alias("name"), F.col("h.format").alias("format"))


@query(r"""
SELECT section_id, CAST(coalesce(nullif(regexp_extract(v, '(?i)(?:chapter|cap[ií]tulo|chapitre)[_\s-]*0*(\d{1,4})', 1), ''), nullif(regexp_extract(v, '(?i)Text/0*(\d{1,4})[_-]', 1), ''), nullif(regexp_extract(v, '/0*(\d{1,4})[_-]', 1), '')) AS INT) AS number
FROM (SELECT DISTINCT section_id, coalesce(title, '') || ' ' || coalesce(path, '') AS v FROM sections)
""")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sections").select("section_id", headings.number_of_section(F.col("title"), F.col("path")).alias("number")).distinct()


@query(r"SELECT DISTINCT title, regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM books WHERE title IS NOT NULL")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").where("title IS NOT NULL").select("title", text.slug(F.col("title")).alias("slug")).distinct()


# Lines, windows, segments ------------------------------------------------------------------------------------------------


@query(f"WITH l AS ({LINES}) SELECT doc_id, line_no, length(line) AS size, lag(length(line)) OVER w AS before, lead(length(line)) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.with_context(lines_of(spark, sf_dir), ["doc_id"], ["line_no"], "line")
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.length("line").cast("bigint").alias("size"), F.length("previous").cast("bigint").alias("before"), F.length("next").cast("bigint").alias("after"))


@query(f"WITH l AS ({LINES}), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM l) SELECT doc_id, count(*) AS lines, count(*) FILTER (b IS NULL OR b <> line) AS kept FROM p GROUP BY doc_id")
def consecutive_dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(spark, sf_dir)
    kept = windows.without_repeats_in_a_row(rows, ["doc_id"], ["line_no"], "line").groupBy("doc_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines")).join(kept, "doc_id")


@query(f"""
WITH l AS ({LINES}), p AS (SELECT *, lead(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS r FROM p WHERE length(line) BETWEEN 1 AND 40 AND after >= 120)
SELECT doc_id, line_no, after AS next_length FROM s WHERE r = 1
""")
def short_then_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.short_then_long(lines_of(spark, sf_dir), ["doc_id"], ["line_no"], "line", 40, 120)
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("next_length").cast("bigint").alias("next_length"))


HEADING = r"(?i)^\s*(?:cap[ií]tulo|chapter|chapitre)\s+\d+"


@query(rf"""
WITH l AS ({LINES}), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{HEADING}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS segment FROM l)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, count(*) AS lines, CAST(min(line_no) AS BIGINT) AS first_line FROM s GROUP BY doc_id, segment
""")
def marker_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.marker_segments(lines_of(spark, sf_dir), ["doc_id"], ["line_no"], F.col("line").rlike(HEADING))
    return rows.groupBy("doc_id", F.col("segment").cast("bigint").alias("segment")).agg(F.count("*").alias("lines"), F.min("line_no").cast("bigint").alias("first_line"))


@query(f"SELECT book_id, edition, section_index, section_id, lead(section_index) OVER (PARTITION BY book_id, edition ORDER BY section_index, section_id) AS end_at FROM {SECTIONS}")
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections").dropDuplicates(["section_id"]).select("book_id", "edition", "section_index", "section_id")
    starts = s.withColumn("document", F.concat_ws("-", "book_id", "edition")).withColumn("at", F.struct("section_index", "section_id"))
    return segment.ranges(starts, "document", "at").select("book_id", "edition", "section_index", "section_id", F.col("end_at.section_index").alias("end_at"))


@query(r"""
WITH n AS (SELECT DISTINCT section_id, node_id, node_key, length(text) AS size FROM text_nodes),
o AS (SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY section_id ORDER BY node_key, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM n),
p AS (SELECT section_id, unnest(range(0, CAST(max(start_at + size) AS BIGINT) + 1, 250)) AS at FROM o GROUP BY section_id)
SELECT p.section_id, p.at, o.node_id FROM p ASOF JOIN o ON p.section_id = o.section_id AND p.at >= o.start_at
""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "text_nodes").select("section_id", "node_id", "node_key", F.length("text").alias("size")).distinct()
    w = windows.Window.partitionBy("section_id").orderBy("node_key", "node_id").rowsBetween(windows.Window.unboundedPreceding, -1)
    spans = n.withColumn("start_at", F.coalesce(F.sum(F.col("size") + 1).over(w), F.lit(0)))
    points = spans.groupBy("section_id").agg(F.max(F.col("start_at") + F.col("size")).alias("last")).select("section_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last", F.lit(250).cast("bigint"))).alias("at"))
    return match.in_range(points, spans, "section_id", "at", "start_at", "node_id")


@query(f"""
WITH w AS (SELECT node_id, section_id, node_key, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS token, generate_subscripts(regexp_extract_all(lower(text), '{WORDS}'), 1) AS place FROM (SELECT DISTINCT node_id, section_id, node_key, text FROM text_nodes))
SELECT section_id, node_id, place, row_number() OVER (PARTITION BY section_id ORDER BY node_key, node_id, place) AS occurrence, count(*) OVER (PARTITION BY section_id) AS occurrences FROM w WHERE token = 'the'
""")
def occurrence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "text_nodes").select("node_id", "section_id", "node_key", "text").distinct()
    words = nodes.select("node_id", "section_id", "node_key", F.posexplode(text.tokens(F.lower("text"))).alias("place", "token")).where("token = 'the'").withColumn("place", (F.col("place") + 1).cast("bigint"))
    return windows.occurrence_numbers(words, ["section_id"], F.col("token"), ["node_key", "node_id", "place"]).select("section_id", "node_id", "place", "occurrence", "occurrences")


@query()
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunk_text(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_index", F.length("chunk").alias("size"))


@query()
def group_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.coalesce(F.octet_length(p), F.lit(0)))
    s, t = (segment.group_by_size(d, "book_id", "section_index", size, 4_000).withColumn("edition", F.lit(e)) for d, e in zip(editions(spark, sf_dir), ("source", "translation")))
    return s.unionByName(t)


# Alignment ---------------------------------------------------------------------------------------------------------------


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY book_id, edition ORDER BY section_index, section_id) AS rank FROM {SECTIONS} WHERE char_count > 0),
j AS (SELECT coalesce(s.book_id, t.book_id) AS book_id, coalesce(s.rank, t.rank) AS rank, s.section_id AS source_section_id, t.section_id AS target_section_id, s.char_count AS a, t.char_count AS b
      FROM (SELECT * FROM r WHERE edition = 'source') s FULL JOIN (SELECT * FROM r WHERE edition = 'translation') t ON s.book_id = t.book_id AND s.rank = t.rank)
SELECT book_id, rank, source_section_id, target_section_id, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' ELSE 'matched' END AS match_type,
       CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE round(least(1.0, greatest(0.1, least(b / a, a / b))), 6) END AS confidence FROM j
""")
def positional_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_id", "section_index", "char_count") for d in editions(spark, sf_dir))
    return align.by_position(s, t, "book_id", ["section_index", "section_id"], "char_count").select("book_id", "rank", "source_section_id", "target_section_id", "match_type", "confidence")


def _title(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(lower({c})), '\s+', ' ', 'g')), '^(?:capitulo|chapitre)\s+', 'chapter '), '^cap\s+', 'chapter '), '')"


NUMBER = r"CAST(coalesce(nullif(regexp_extract(v, '(?i)(?:chapter|cap[ií]tulo|chapitre)[_\s-]*0*(\d{1,4})', 1), ''), nullif(regexp_extract(v, '(?i)Text/0*(\d{1,4})[_-]', 1), ''), nullif(regexp_extract(v, '/0*(\d{1,4})[_-]', 1), '')) AS INT)"
CASCADE = f"""
WITH p AS (SELECT *, {NUMBER} AS number, {_title("title")} AS tkey FROM (SELECT *, coalesce(title, '') || ' ' || coalesce(path, '') AS v FROM {SECTIONS})),
s AS (SELECT * FROM p WHERE edition = 'source'), t AS (SELECT * FROM p WHERE edition = 'translation'),
a AS (SELECT book_id, number, arg_min(section_id, (section_index, section_id)) AS id FROM s WHERE number IS NOT NULL GROUP BY ALL),
b AS (SELECT book_id, tkey, arg_min(section_id, (section_index, section_id)) AS id FROM s WHERE tkey IS NOT NULL GROUP BY ALL),
c AS (SELECT book_id, section_index, arg_min(section_id, section_id) AS id FROM s GROUP BY ALL),
out AS (SELECT t.book_id, t.section_id AS target, coalesce(a.id, b.id, c.id) AS source, CASE WHEN a.id IS NOT NULL THEN 0.95 WHEN b.id IS NOT NULL THEN 0.9 WHEN c.id IS NOT NULL THEN 0.35 ELSE 0.0 END AS confidence,
  CASE WHEN a.id IS NOT NULL THEN 'chapter_number_match' WHEN b.id IS NOT NULL THEN 'normalized_title_match' WHEN c.id IS NOT NULL THEN 'index_fallback_low_confidence' ELSE 'no_alignment_candidate' END AS reason
  FROM t LEFT JOIN a ON t.book_id = a.book_id AND t.number = a.number LEFT JOIN b ON t.book_id = b.book_id AND t.tkey = b.tkey LEFT JOIN c ON t.book_id = c.book_id AND t.section_index = c.section_index)
"""


@query(CASCADE + "SELECT book_id, target, source, CAST(confidence AS DOUBLE) AS confidence, reason FROM out")
def cascade_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.cascade(*editions(spark, sf_dir), "book_id", "section_id", "section_index", "title", "path")


@query(
    CASCADE
    + """, stats AS (SELECT book_id, count(*) AS sections, count(*) FILTER (confidence >= 0.8) AS reliable, count(*) FILTER (confidence > 0 AND confidence < 0.8) AS weak, count(*) FILTER (confidence = 0) AS unmatched FROM out GROUP BY book_id)
SELECT *, CASE WHEN unmatched > 3 THEN 'FAIL' WHEN unmatched > 1 THEN 'WARN' ELSE 'OK' END AS severity FROM stats"""
)
def alignment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_stats(cascade_align(spark, sf_dir), "book_id")


@query()
def similarity_best_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = editions(spark, sf_dir)
    matched = cascade_align(spark, sf_dir).where("confidence >= 0.8").select(F.col("source").alias("chapter"), F.col("target").alias("section_id"))
    flat = lambda d, *c: d.select(*c, F.posexplode("paragraphs").alias("no", "text")).withColumn("paragraph", F.concat_ws("-", "section_id", "no"))
    a = flat(s.withColumn("chapter", F.col("section_id")), "chapter", "section_id").join(matched.select("chapter").distinct(), "chapter", "left_semi")
    b = flat(t.join(matched, "section_id"), "chapter", "section_id")
    return align.align_paragraphs(a, b, ["chapter"], "paragraph", "text")


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY book_id, edition ORDER BY section_index, section_id) AS rank FROM {SECTIONS} WHERE char_count > 0),
j AS (SELECT coalesce(s.book_id, t.book_id) AS book_id, coalesce(s.rank, t.rank) AS rank, s.char_count AS a, t.char_count AS b, s.section_id AS si, t.section_id AS ti, len(s.paragraphs) AS pa, len(t.paragraphs) AS pb
      FROM (SELECT * FROM r WHERE edition = 'source') s FULL JOIN (SELECT * FROM r WHERE edition = 'translation') t ON s.book_id = t.book_id AND s.rank = t.rank),
f AS (SELECT book_id || '-' || rank AS unit, 'missing_sections' AS type, 'FAIL' AS severity FROM j WHERE ti IS NULL
  UNION ALL SELECT book_id || '-' || rank, 'extra_sections', 'WARN' FROM j WHERE si IS NULL
  UNION ALL SELECT book_id || '-' || rank, CASE WHEN round(b / a, 3) < 0.35 THEN 'section_too_short' ELSE 'section_short' END, CASE WHEN round(b / a, 3) < 0.35 THEN 'FAIL' ELSE 'WARN' END FROM j WHERE si IS NOT NULL AND ti IS NOT NULL AND a >= 800 AND round(b / a, 3) < 0.55
  UNION ALL SELECT book_id || '-' || rank, 'paragraph_count_low', 'WARN' FROM j WHERE si IS NOT NULL AND ti IS NOT NULL AND a >= 800 AND pa >= 10 AND pb / greatest(pa, 1) < 0.35)
SELECT unit, type, severity FROM f
""")
def section_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = (d.select("book_id", "section_id", "section_index", "char_count", F.size("paragraphs").alias("n")) for d in editions(spark, sf_dir))
    both = align.by_position(s, t, "book_id", ["section_index", "section_id"], "char_count")
    unit = F.concat_ws("-", "book_id", "rank")
    return detect.section_findings(both, unit, "source_char_count", "target_char_count", "source_n", "target_n").select("unit", "type", "severity")


def paired_sections(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Texts ``a`` and ``b`` of the two editions by book and index; a full outer join keeps what one edition lacks, as null."""
    s, t = editions(spark, sf_dir)
    joined = F.array_join("paragraphs", "\n")
    flat = lambda d, c: d.select("book_id", "section_index", (joined if how == "inner" else F.coalesce(joined, F.lit(""))).alias(c))
    first = lambda d: windows.keep_first(d, ["book_id", "section_index"], ["section_id"])
    return flat(first(s), "a").join(flat(first(t), "b"), ["book_id", "section_index"], how).withColumn("unit", F.concat_ws("-", "book_id", "section_index"))


PAIRED = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY book_id, edition, section_index ORDER BY section_id) AS r FROM sections),
p AS (SELECT s.book_id || '-' || s.section_index AS unit, array_to_string(s.paragraphs, chr(10)) AS a, array_to_string(t.paragraphs, chr(10)) AS b FROM f s JOIN f t ON s.book_id = t.book_id AND s.section_index = t.section_index AND s.edition = 'source' AND t.edition = 'translation' AND s.r = 1 AND t.r = 1)
"""


@query(PAIRED + r", n AS (SELECT unit, list_sort(list_distinct(list_filter(regexp_extract_all(a, '\d+'), lambda x: length(x) > 1 AND NOT list_contains(regexp_extract_all(b, '\d+'), x)))) AS lost FROM p) SELECT unit, array_to_string(lost, ',') AS detail FROM n WHERE len(lost) > 0")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pair_findings(paired_sections(spark, sf_dir), "unit", "a", "b").where("type = 'number_missing'").select("unit", "detail")


FLAT = r"length(trim(regexp_replace({}, '[\s\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g')))"


@query(PAIRED + f", r AS (SELECT unit, {FLAT.format('b')} / {FLAT.format('a')} AS ratio FROM p WHERE {FLAT.format('a')} > 0 AND {FLAT.format('b')} > 0) SELECT unit, CASE WHEN ratio < 0.42 OR ratio > 2.7 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE ratio < 0.58 OR ratio > 2.1")
def length_ratio_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pair_findings(paired_sections(spark, sf_dir), "unit", "a", "b").where("type = 'omission_or_expansion'").select("unit", "severity")


@query()
def pair_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pair_findings(paired_sections(spark, sf_dir), "unit", "a", "b")


@query()
def coverage_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.coverage_findings(paired_sections(spark, sf_dir, "full"), "unit", "a", "b")


@query(f"""
WITH t AS (SELECT book_id, sum(char_count) FILTER (edition = 'source') AS a, sum(char_count) FILTER (edition = 'translation') AS b FROM {SECTIONS} GROUP BY book_id),
r AS (SELECT book_id, coalesce(b, 0) / greatest(coalesce(a, 0), 1) AS ratio FROM t)
SELECT CAST(book_id AS VARCHAR) AS unit, CASE WHEN ratio < 0.55 THEN 'translation_too_short' ELSE 'translation_too_long' END AS type FROM r WHERE ratio < 0.55 OR ratio > 1.65
""")
def document_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections").dropDuplicates(["section_id"])
    of = lambda e: F.coalesce(F.sum(F.when(F.col("edition") == e, F.col("char_count"))), F.lit(0))
    return detect.document_ratio(s.groupBy("book_id").agg(of("source").alias("a"), of("translation").alias("b")), "book_id", "a", "b").select("unit", "type")


# Similarity and names ----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT canonical, original_name, CAST(levenshtein(canonical, original_name) AS BIGINT) AS edits FROM entities WHERE regexp_full_match(canonical, '[ -~]+') AND regexp_full_match(original_name, '[ -~]+') AND levenshtein(canonical, original_name) <= 3")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("canonical"), F.col("original_name")
    plain = table(spark, sf_dir, "entities").where(a.rlike(r"^[ -~]+\z") & b.rlike(r"^[ -~]+\z"))  # the other engine counts bytes
    return plain.where(similarity.within_edits(a, b, 3)).select("canonical", "original_name", F.levenshtein(a, b).cast("bigint").alias("edits")).distinct()


@query()
def levenshtein_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``levenshtein_pairs`` over all rows; distances count code points, so the byte-counting SQL is no twin."""
    a, b = F.col("canonical"), F.col("original_name")
    return table(spark, sf_dir, "entities").where(similarity.within_edits(a, b, 3)).select("canonical", "original_name", F.levenshtein(a, b).cast("bigint").alias("edits")).distinct()


def _grams(c: str) -> str:
    return rf"list_distinct(list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)))"


@query(rf"""
WITH n AS (SELECT DISTINCT canonical, original_name, regexp_replace(lower(canonical), '\s+', '', 'g') AS a, regexp_replace(lower(original_name), '\s+', '', 'g') AS b FROM entities WHERE canonical IS NOT NULL AND original_name IS NOT NULL),
g AS (SELECT *, {_grams("a")} AS x, {_grams("b")} AS y FROM n)
SELECT canonical, original_name, CASE WHEN len(x) + len(y) > 0 THEN round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) ELSE 0.0 END AS dice FROM g
""")
def dice_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entities").where("canonical IS NOT NULL AND original_name IS NOT NULL").select("canonical", "original_name").distinct()
    return rows.withColumn("dice", F.round(similarity.dice(F.col("canonical"), F.col("original_name")), 6))


@query(r"""
WITH k AS (SELECT DISTINCT c.chunk_id, list_distinct(regexp_extract_all(strip_accents(lower(instruction)), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(strip_accents(lower(coalesce(output_text, ''))), '[a-z0-9]+')) AS y FROM chunks c)
SELECT chunk_id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 3) ELSE 0.0 END AS jaccard FROM k
""")
def jaccard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select("chunk_id", similarity.jaccard(text.ascii_set(F.col("instruction")), text.ascii_set(F.col("output_text"))).alias("jaccard"))
    return rows.distinct()


@query()
def name_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "entities").where("trim(canonical) != ''").groupBy("book_id", F.trim("canonical").alias("name")).agg(F.count("*").alias("n"))
    return detect.name_variants(names, ["book_id"], "name", "n")


# Glossary ----------------------------------------------------------------------------------------------------------------

HITS = """
WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS words FROM documents),
g AS (SELECT DISTINCT from_text AS term, regexp_extract_all(strip_accents(lower(from_text)), '[\\p{L}\\p{N}]+') AS parts FROM terms WHERE trim(coalesce(from_text, '')) <> ''),
a AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w)
"""


@query(HITS + "SELECT doc_id, term, count(*) AS hits FROM a JOIN g ON word = parts[1] AND list_slice(words, i, i + len(parts) - 1) = parts GROUP BY doc_id, term")
def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.glossary_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "terms"), ["doc_id"], "text")


@query(HITS + ", h AS (SELECT doc_id, term, count(*) AS hits FROM a JOIN g ON word = parts[1] AND list_slice(words, i, i + len(parts) - 1) = parts GROUP BY doc_id, term), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS rank FROM h) SELECT term, rank, doc_id, hits FROM r WHERE rank <= 25")
def term_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.term_locations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "terms"), ["doc_id"], "text", "from_text").select("term", "rank", "doc_id", "hits")


@query()
def terminology_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.terminology_findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "terms"), "doc_id", "text")


@query()
def alias_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correct.replace_from_table(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "terms"), ["doc_id"], "text")
    return out.select("doc_id", "replacements", F.md5("corrected").alias("digest"))


@query()
def kwic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, terms = table(spark, sf_dir, "documents"), table(spark, sf_dir, "terms")
    hits = match.glossary_hits(docs, terms, ["doc_id"], "text").select("doc_id", "term").join(docs.select("doc_id", "text"), "doc_id")
    return hits.select("doc_id", "term", F.explode(text.kwic()(F.col("text"), F.col("term"))).alias("x")).select("doc_id", "term", "x.at", "x.context")


# Rules and findings ------------------------------------------------------------------------------------------------------


def _q(p: str) -> str:
    return p.replace("'", "''")


RULE_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS type, '{s}' AS severity, len(regexp_extract_all(text, '{_q(p)}')) AS hits FROM documents WHERE len(regexp_extract_all(text, '{_q(p)}')) >= {m}" for n, p, m, s in RULES)


@query(f"SELECT CAST(doc_id AS VARCHAR) AS unit, type, severity, CAST(hits AS BIGINT) AS occurrences FROM ({RULE_SQL})")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_rules(table(spark, sf_dir, "documents"), "doc_id", "text", RULES).drop("detail")


@query(f"""
WITH f AS (SELECT coalesce(source, '-') AS source, type, severity, hits FROM ({RULE_SQL}) JOIN documents USING (doc_id)),
s AS (SELECT source, count(*) AS total, count(*) FILTER (severity = 'FAIL') AS fail, count(*) FILTER (severity = 'WARN') AS warn, count(*) FILTER (severity = 'INFO') AS info, count(DISTINCT type) AS types FROM f GROUP BY source)
SELECT *, CASE WHEN fail > 0 THEN 'FAIL' WHEN warn > 0 THEN 'WARN' ELSE 'OK' END AS status FROM s
""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rule_findings(spark, sf_dir).join(docs.select(F.col("doc_id").cast("string").alias("unit"), F.coalesce("source", F.lit("-")).alias("source")), "unit")
    return aggregate.run_summary(found, ["source"])


@query(f"""
WITH f AS (SELECT coalesce(source, '-') AS source, severity FROM ({RULE_SQL}) JOIN documents USING (doc_id)),
s AS (SELECT source, count(*) FILTER (severity = 'FAIL') AS h, count(*) FILTER (severity = 'WARN') AS m, count(*) FILTER (severity = 'INFO') AS l FROM f GROUP BY source)
SELECT source, round(greatest(0.0, least(10.0, 10 - (2 * h + m + 0.5 * l) / 10)), 1) AS health FROM s
""")
def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.reading_scores(run_status(spark, sf_dir), F.col("fail"), F.col("warn"), F.col("info")).select("source", "health")


@query(f"""
WITH f AS (SELECT coalesce(source, '-') AS source, doc_id, type FROM ({RULE_SQL}) JOIN documents USING (doc_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY doc_id) AS k FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, type) AS t FROM a WHERE k <= 30)
SELECT source, doc_id, type FROM b WHERE t <= 120
""")
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("source"))
    found = rule_findings(spark, sf_dir).withColumn("doc_id", F.col("unit").cast("bigint")).join(docs, "doc_id")
    return windows.capped(found, ["source"], "type", ["doc_id", "type"]).select("source", "doc_id", "type")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS unit, type, CAST(hits AS BIGINT) AS occurrences FROM ({RULE_SQL}) ORDER BY CASE severity WHEN 'FAIL' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, hits DESC, type, doc_id LIMIT 10")
def severity_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [findings.severity_rank(F.col("severity")), F.desc("occurrences"), "type", F.col("unit").cast("bigint")]
    return findings.top(rule_findings(spark, sf_dir), by, 10).select("unit", "type", "occurrences")


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(right(text, 50), '\s+$', '') AS t FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS unit, CASE WHEN regexp_matches(t, '\.\.\.$') THEN 'ends_with_dots' WHEN regexp_matches(t, '(?i)[a-z]$') THEN 'ends_with_letter' ELSE 'ends_with_comma' END AS type
FROM t WHERE regexp_matches(t, '\.\.\.$|(?i)[a-z]$|,$')
""")
def ending_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ending_findings(table(spark, sf_dir, "documents"), "doc_id", "text").where("type != 'short_last_line'").select("unit", "type")


@query(r"""
WITH n AS (SELECT doc_id, abs(len(regexp_extract_all(text, '\(')) - len(regexp_extract_all(text, '\)'))) AS p, abs(len(regexp_extract_all(text, '[“«]')) - len(regexp_extract_all(text, '[”»]'))) AS q FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS unit, 'unmatched_parentheses' AS type, p AS occurrences FROM n WHERE p > 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unmatched_quotes', q FROM n WHERE q > 2
""")
def balance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.balance_findings(table(spark, sf_dir, "documents"), "doc_id", "text").select("unit", "type", "occurrences")


@query()
def repetition_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.repetition_findings(table(spark, sf_dir, "documents"), "doc_id", "text")


FIX: correct.Rules = [(r" {2,}", " "), (r"\s+([,.;:!?])", "$1"), (r"\.{3}", "…"), (r"(?i)\bteh\b", "the")]


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\.{3}', '…', 'g'), '(?i)\bteh\b', 'the', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def ordered_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(correct.apply_rules(F.col("text"), FIX)).alias("digest"))


@query(f"""
WITH l AS ({LINES}), w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents),
t AS (SELECT doc_id, w, regexp_replace(w, '[^\\p{{L}}]', '', 'g') AS token FROM w WHERE w <> ''), lexicon AS (SELECT DISTINCT token FROM (VALUES {MARKERS}) AS v(token, lang) WHERE lang = 'en')
SELECT doc_id, count(*) AS words, count(*) FILTER (token IN (SELECT token FROM lexicon)) AS hits FROM t GROUP BY doc_id
""")
def residual_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame([(w,) for w in detect.MARKERS["en"]], "token string")
    return aggregate.residual_ratio(table(spark, sf_dir, "documents"), ["doc_id"], "text", lexicon).select("doc_id", "words", "hits")


# Keys, ranges, sets, state -----------------------------------------------------------------------------------------------


@query(f"WITH n AS (SELECT DISTINCT book_id, edition, chapter_number AS n FROM {SECTIONS} WHERE chapter_number IS NOT NULL), g AS (SELECT *, lead(n) OVER (PARTITION BY book_id, edition ORDER BY n) AS x FROM n) SELECT book_id, edition, n + 1 AS from_number, x - 1 AS to_number FROM g WHERE x > n + 1")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.missing_numbers(table(spark, sf_dir, "sections"), ["book_id", "edition"], "chapter_number")


@query(f"""
WITH s AS (SELECT *, lag(chapter_number) OVER (PARTITION BY book_id, edition ORDER BY section_index, section_id) AS p FROM {SECTIONS} WHERE chapter_number IS NOT NULL)
SELECT section_id, CASE WHEN chapter_number = p THEN 'duplicate' WHEN chapter_number < p THEN 'out_of_order' ELSE 'gap' END AS problem FROM s WHERE chapter_number = p OR chapter_number < p OR chapter_number > p + 1
""")
def sequence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections").dropDuplicates(["section_id"])
    return windows.sequence_problems(s, ["book_id", "edition"], ["section_index", "section_id"], "chapter_number").select("section_id", "problem")


BOOKS = "(SELECT DISTINCT * FROM books)"


@query(f"""
WITH b AS (SELECT *, lag(book_id) OVER w AS previous, lag(last_chapter) OVER w AS p FROM {BOOKS} WINDOW w AS (PARTITION BY source ORDER BY first_chapter NULLS LAST, book_id))
SELECT source, previous, book_id, CASE WHEN first_chapter > p + 1 THEN 'gap' ELSE 'overlap' END AS kind, CASE WHEN first_chapter > p + 1 THEN p + 1 ELSE first_chapter END AS from_number,
       CASE WHEN first_chapter > p + 1 THEN first_chapter - 1 ELSE least(last_chapter, p) END AS to_number FROM b WHERE first_chapter > p + 1 OR first_chapter <= p
""")
def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.range_problems(table(spark, sf_dir, "books").distinct(), ["source"], "book_id", "first_chapter", "last_chapter")


@query(f"WITH e AS (SELECT source, book_id, unnest(range(first_chapter, last_chapter + 1)) AS number FROM {BOOKS} WHERE first_chapter <= last_chapter) SELECT source, number, count(DISTINCT book_id) AS n FROM e GROUP BY source, number HAVING count(DISTINCT book_id) > 1")
def covered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.covered_twice(table(spark, sf_dir, "books").distinct(), ["source"], "book_id", "first_chapter", "last_chapter")
    return out.select("source", F.col("number").cast("bigint").alias("number"), "n")


@query(" UNION ALL ".join(f"SELECT source, '{f}' AS field, array_to_string(list_sort(list(DISTINCT coalesce(CAST({f} AS VARCHAR), '(none)'))), '|') AS vals FROM books GROUP BY source HAVING count(DISTINCT coalesce(CAST({f} AS VARCHAR), '(none)')) > 1" for f in ("publisher", "source_lang", "target_lang")))
def metadata_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.metadata_differences(table(spark, sf_dir, "books"), ["source"], ["publisher", "source_lang", "target_lang"])
    return out.select("source", "field", F.array_join("values", "|").alias("vals"))


@query("SELECT source, book_id, chapter_number, count(*) AS n, count(DISTINCT md5(text)) AS contents, CASE WHEN count(DISTINCT md5(text)) > 1 THEN 'samePathDifferentHash' ELSE 'samePathSameHash' END AS type FROM documents GROUP BY ALL HAVING count(*) > 1")
def collision_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.md5("text"))
    return aggregate.collisions(docs, ["source", "book_id", "chapter_number"], "digest")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY created_at, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1 UNION ALL SELECT doc_id, source FROM documents WHERE text IS NULL")
def dedupe_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dedupe(table(spark, sf_dir, "documents"), F.md5("text"), ["created_at", "doc_id"]).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM language_reports WHERE is_match)")
def resolved_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unresolved(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_reports").where("is_match"), ["doc_id"]).select("doc_id")


@query("SELECT d.doc_id, r.report_id, r.detected_language FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY report_id DESC) AS n FROM (SELECT DISTINCT * FROM language_reports)) r ON d.doc_id = r.doc_id AND r.n = 1")
def state_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.carry_state(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "language_reports").distinct(), ["doc_id"], "report_id", ["report_id", "detected_language"])


@query(f"WITH s AS (SELECT DISTINCT section_id FROM sections), n AS (SELECT DISTINCT section_id FROM text_nodes) SELECT 'missing_nodes' AS kind, count(*) AS n FROM s WHERE section_id NOT IN (SELECT section_id FROM n) UNION ALL SELECT 'covered', count(*) FROM s WHERE section_id IN (SELECT section_id FROM n)")
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, left = match.coverage(table(spark, sf_dir, "sections").select("section_id").distinct(), table(spark, sf_dir, "text_nodes"), ["section_id"])
    return left.agg(F.count("*").alias("n")).select(F.lit("missing_nodes").alias("kind"), "n").unionByName(done.agg(F.count("*").alias("n")).select(F.lit("covered").alias("kind"), "n"))


@query("SELECT user_id % 10 AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def queue_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.pivot_counts(table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10), ["bucket"], "event_type", ["click", "error", "purchase", "signup", "view"])


@query("""
WITH m AS (SELECT (min(event_id) + max(event_id)) / 2 AS m FROM events), e AS (SELECT event_type, count(*) FILTER (event_id <= m) AS before, count(*) FILTER (event_id > m) AS after FROM events, m GROUP BY event_type)
SELECT *, after - before AS delta, CASE WHEN after < before THEN 'better' WHEN after > before THEN 'worse' ELSE 'same' END AS direction FROM e
""")
def before_after_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("n", F.lit(1))
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    return aggregate.compare_runs(e.where(F.col("event_id") <= (low + high) / 2), e.where(F.col("event_id") > (low + high) / 2), ["event_type"], "n")


@query()
def model_output_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses against the paragraph they were made from."""
    rows = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    of = lambda name, origin: table(spark, sf_dir, name).dropDuplicates([f"{origin}_id"]).select(F.lit(origin).alias("origin"), F.col(f"{origin}_id").alias("origin_id"), F.posexplode("paragraphs").alias("paragraph_index", "_source"))
    rows = rows.join(of("chapters", "chapter").unionByName(of("sections", "section")), ["origin", "origin_id", "paragraph_index"], "left")
    p = model_text.output_problems(F.col("_source"), F.col("output_text"))
    return rows.select("chunk_id", model_text.worst(p).alias("severity"), F.array_join(F.transform(p, lambda x: x["code"]), ",").alias("codes"))


# Composite plans ---------------------------------------------------------------------------------------------------------


@query()
def semantic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.semantic_audit(paired_sections(spark, sf_dir), table(spark, sf_dir, "terms"), "book_id", "section_index", "unit", "a", "b")


@query()
def comparison_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved are the numbers missing in chapters whose source has no chapter number: a reader checked those by hand."""
    pairs = paired_sections(spark, sf_dir, "full")
    s, t = (windows.keep_first(d, ["book_id", "section_index"], ["section_id"]).select("book_id", "section_index", F.col("title").alias(c), F.col("chapter_number").alias(f"{c}_no")) for d, c in zip(editions(spark, sf_dir), ("expected", "title")))
    pairs = pairs.join(s, ["book_id", "section_index"], "left").join(t, ["book_id", "section_index"], "left")
    lost = detect.coverage_findings(pairs.where("expected_no IS NULL"), "unit", "a", "b").where("type = 'numbers_missing'")
    resolved = lost.select(findings.stable_key(F.col("unit"), F.col("type"), F.col("detail")).alias("stable_key"))
    categories = spark.createDataFrame([("chapter_missing",), ("numbers_missing",), ("names_missing",), ("title_mismatch",), ("residual_phrase",), ("editorial",)], "category string")
    return pipelines.comparison_audit(pairs, table(spark, sf_dir, "terms"), resolved, categories, "unit", "a", "b", ("title", "expected"), ["of the", "in the", "and the"])[1].select("category", "n")


@query(f"""
WITH b AS {BOOKS}, r AS (SELECT *, lag(last_chapter) OVER (PARTITION BY source ORDER BY first_chapter NULLS LAST, book_id) AS p FROM b WHERE first_chapter <= last_chapter),
e AS (SELECT source, book_id, unnest(range(first_chapter, last_chapter + 1)) AS n FROM b WHERE first_chapter <= last_chapter),
x AS (SELECT source, 'AMBIGUOUS_RANGE' AS code, 1 AS err FROM b WHERE first_chapter IS NULL OR last_chapter IS NULL UNION ALL SELECT source, 'INVALID_RANGE', 1 FROM b WHERE first_chapter > last_chapter
  UNION ALL SELECT source, CASE WHEN first_chapter > p + 1 THEN 'GAP' ELSE 'OVERLAP' END, CASE WHEN first_chapter > p + 1 THEN 0 ELSE 1 END FROM r WHERE first_chapter > p + 1 OR first_chapter <= p
  UNION ALL SELECT source, 'DUPLICATE_CHAPTERS', 1 FROM (SELECT source, n FROM e GROUP BY source, n HAVING count(DISTINCT book_id) > 1)
  UNION ALL SELECT source, 'METADATA_DIFFERENCE', 0 FROM b GROUP BY source HAVING count(DISTINCT coalesce(publisher, '(none)')) > 1)
SELECT source, code, count(*) AS n, CASE WHEN max(max(err)) OVER (PARTITION BY source) = 1 THEN 'blocked' ELSE 'ready_for_merge' END AS status FROM x GROUP BY source, code
""")
def merge_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.merge_precheck(table(spark, sf_dir, "books").distinct(), "source", "book_id", "first_chapter", "last_chapter", ["publisher"])
    return out.groupBy("source", "code", "status").agg(F.count("*").alias("n"))


@query()
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections").dropDuplicates(["section_id"])
    return pipelines.structure(s, table(spark, sf_dir, "books"), "book_id", "edition", "section_index", "title", "chapter_number", "first_chapter", "last_chapter")


@query()
def fix_and_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.fix_and_compare(table(spark, sf_dir, "documents"), "doc_id", "text", FIX, RULES)


# Events (extension) ------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS flow FROM events GROUP BY user_id")
def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.event_flows(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id").withColumn("flow", F.array_join("flow", ">"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(table(spark, sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1, 2")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sliding(table(spark, sf_dir, "events"))


@query("""
WITH p AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM p)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, s
""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events"))


# Star tables (extension) -------------------------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def tpch_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def tpch_nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    # Lines are summed by order before any join, so the wide table moves once.
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    rows = per.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("k").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def tpch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def tpch_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.row_number().over(w).alias("rank")).where("rank <= 3")
