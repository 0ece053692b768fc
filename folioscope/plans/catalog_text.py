"""Queries over the column functions: each calls the functions on whole tables, and SQL says the same for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import headings, model_text, similarity, text
from folioscope.operators import validate
from folioscope.plans.catalog import ORACLE, QUERIES
from folioscope.session import table

BLANKS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANKS}', ' ', 'g'))"


def fold(x: str) -> str:
    return f"strip_accents(lower(coalesce({x}, '')))"


def comparable(x: str) -> str:
    return compact(rf"regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}\s-]', ' ', 'g')")


def key_text(x: str) -> str:
    return compact(f"regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g')")


def words(x: str) -> str:
    return rf"regexp_extract_all({fold(x)}, '[\p{{L}}\p{{N}}]{{3,}}')"


def joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ' ')"


def without_markup(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{to}')"
    return compact(f"regexp_replace({t}, '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g')")


def columns(name: str, source: str, ident: str, made: dict[str, tuple[Callable[[], Column], str]], where: str = "true", distinct: bool = True) -> None:
    """Register a query of computed columns over a table, one pair of engine expression and SQL expression a column."""
    keys = [k for k in ident.split(", ") if k]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).where(where).select(*keys, *(f().alias(c) for c, (f, _) in made.items()))
        return rows.distinct() if distinct else rows

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {'DISTINCT ' if distinct else ''}{', '.join([*keys, *(f'{q} AS {c}' for c, (_, q) in made.items())])} FROM {source} WHERE {where}"


T, C, Q = lambda: F.col("text"), lambda: F.col("title"), lambda: F.col("output_text")
big = lambda c: c.cast("bigint")
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# Cleaning and keys -------------------------------------------------------------------------------------------------------
columns("normalized_text", "documents", "doc_id", {
    "early": (lambda: F.md5(text.normalized(T())), "md5(" + compact(f"regexp_replace(coalesce(text, ''), '{CONTROLS}', '', 'g')") + ")"),
    "late": (lambda: F.md5(text.normalized_late(T())), f"md5(regexp_replace({compact('text')}, '{CONTROLS}', '', 'g'))"),
})
columns("comparable_text", "text_nodes", "node_id", {"digest": (lambda: F.md5(text.comparable(T())), f"md5({comparable('text')})")})
columns("key_texts", "sections", "title", {
    "key": (lambda: text.key_text(C()), key_text("title")),
    "heading": (lambda: text.heading_key(C()), compact(rf"regexp_replace({fold('title')}, '[^\w\s]', ' ', 'g')")),
})
columns("markup_clean", "chunks", "chunk_id", {"digest": (lambda: F.md5(text.without_markup(Q())), f"md5({without_markup('output_text')})")})
columns("word_clean", "entities", "canonical", {
    "word": (lambda: text.clean_word(F.col("canonical")), r"regexp_replace(lower(canonical), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"),
})
columns("markup_escape", "chunks", "chunk_id", {
    "digest": (lambda: F.md5(text.escape_markup(Q())), "md5(replace(replace(replace(replace(replace(output_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'))"),
}, "output_text IS NOT NULL")
columns("language_tags", "language_reports", "metadata_language", {
    "tag": (lambda: text.language_tag(F.col("metadata_language")), """CASE WHEN trim(metadata_language) <> '' THEN array_to_string(list_prepend(lower(string_split(trim(replace(metadata_language, '_', '-')), '-')[1]),
       list_transform(string_split(trim(replace(metadata_language, '_', '-')), '-')[2:11], lambda p: CASE WHEN length(p) = 2 THEN upper(p) WHEN length(p) = 4 THEN upper(p[1]) || lower(p[2:]) ELSE lower(p) END)), '-') END"""),
})

# Tokens, names, numbers --------------------------------------------------------------------------------------------------
columns("long_tokens", "text_nodes", "node_id", {"tokens": (lambda: F.array_join(text.long_tokens(T()), " "), f"array_to_string({words('text')}, ' ')")})
STOP = ["that", "with", "para", "pour", "como", "dans"]
columns("content_tokens", "text_nodes", "node_id", {
    "tokens": (lambda: F.array_join(F.array_sort(text.content_tokens(T(), STOP)), " "), joined(f"list_filter(regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}]{{4,}}'), lambda x: x NOT IN ({', '.join(map(repr, STOP))}))")),
})
columns("letter_sets", "text_nodes", "node_id", {"letters": (lambda: F.array_join(F.array_sort(text.letter_set(T())), " "), joined(rf"regexp_extract_all({fold('text')}, '\p{{L}}+')"))})
columns("punctuation_profiles", "documents", "doc_id", {
    f: (lambda f=f: text.punctuation_profile(T())[f], f"regexp_matches(coalesce(text, ''), '{p}')") for f, p in (("question", "[?？]"), ("exclamation", "[!！]"), ("quote", "[\"“”‘’«»「」]"))
})
columns("standalone_numbers", "text_nodes", "node_id", {
    "has_two": (lambda: text.has_number(T(), F.lit("2")), r"list_contains(list_transform(regexp_extract_all(coalesce(text, ''), '(?:^|[^\d.,])(\d+(?:[.,]\d+)?)', 1), lambda x: x), '2') OR (list_contains(regexp_extract_all(coalesce(text, ''), '(?:^|[^\d.,])(\d+(?:[.,]\d+)?)', 1), '200') AND regexp_matches(text, '(?i)\d\s*cm\b'))"),
}, "text IS NOT NULL")
columns("sentence_split", "documents", "doc_id", {
    "sentences": (lambda: big(F.size(text.sentences(T()))), f"len(list_filter(string_split(regexp_replace({compact('text')}, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))"),
    "digest": (lambda: F.md5(F.array_join(text.sentences(T()), "|")), f"md5(array_to_string(list_filter(string_split(regexp_replace({compact('text')}, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), '|'))"),
})
SENTENCE = f"string_split(regexp_replace({compact('text')}, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1))"
HIT = f"coalesce(list_filter({SENTENCE}, lambda s: s <> '' AND contains({comparable('s')}, 'river'))[1], text)"
columns("sentence_with_needle", "text_nodes", "node_id", {
    "sentence": (lambda: text.sentence_containing(T(), F.lit("river"), 60), f"CASE WHEN length({compact(HIT)}) > 60 THEN rtrim({compact(HIT)}[1:57], ' ') || '...' ELSE {compact(HIT)} END"),
}, "text IS NOT NULL")
columns("previews", "documents", "doc_id", {
    "preview": (lambda: F.md5(text.preview(T())), f"md5(CASE WHEN length({compact('text')}) > 300 THEN rtrim({compact('text')}[1:297], ' ') || '...' ELSE {compact('text')} END)"),
    "excerpt": (lambda: F.md5(text.excerpt(T())), f"md5(CASE WHEN length({compact('text')}) > 520 THEN {compact('text')}[1:519] || '…' ELSE {compact('text')} END)"),
})
SPLIT = f"string_split({compact('text')}, ' ')"
CLEAN = r"regexp_replace(lower(w), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
AT = f"list_position(list_transform({SPLIT}, lambda w: {CLEAN}), 'river')"
columns("words_around_term", "text_nodes", "node_id", {
    "around": (lambda: text.words_around(T(), F.lit("river")), f"CASE WHEN {AT} > 0 THEN array_to_string({SPLIT}[greatest({AT} - 6, 1):{AT} + 6], ' ') END"),
}, "text IS NOT NULL")
TERM = r"len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w = 'river'))"
columns("term_counts", "documents", "doc_id", {
    "has": (lambda: text.has_term(T(), "river"), f"{TERM} > 0"), "n": (lambda: big(text.count_term(T(), F.lit("river"))), TERM),
}, "text IS NOT NULL")
columns("edge_words", "text_nodes", "node_id", {
    "first": (lambda: text.first_words(T(), 3), f"array_to_string({SPLIT}[1:3], ' ')"), "last": (lambda: text.last_words(T(), 3), f"array_to_string({SPLIT}[greatest(len({SPLIT}) - 2, 1):], ' ')"),
})
columns("text_counters", "documents", "doc_id", {
    "paragraphs": (lambda: big(text.count_paragraphs(T())), r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: trim(p) <> ''))"),
    "lines": (lambda: big(text.count_lines(T())), r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda p: trim(p) <> ''))"),
})
LEFT = "list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] IN ('the', 'el', 'o') THEN i END), lambda i: i IS NOT NULL)"
RIGHT = "list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] IN ('river', 'rio') THEN i END), lambda i: i IS NOT NULL)"
QUERIES["closest_distances"] = lambda spark, sf: table(spark, sf, "text_nodes").select("node_id", text.tokens(F.lower("text")).alias("w")).distinct().select("node_id", similarity.closest_distance(F.col("w"), F.array(*map(F.lit, ("the", "el", "o"))), F.array(*map(F.lit, ("river", "rio")))).alias("distance"))
ORACLE["closest_distances"] = rf"""
WITH n AS (SELECT DISTINCT node_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’-]*'), lambda x: strip_accents(x)) AS w FROM text_nodes)
SELECT node_id, CAST(list_min(flatten(list_transform({LEFT}, lambda a: list_transform({RIGHT}, lambda b: abs(a - b))))) AS INT) AS distance FROM n"""

# Headings ----------------------------------------------------------------------------------------------------------------
columns("leading_numbers", "sections", "title", {
    "number": (lambda: headings.leading_number(C()), r"TRY_CAST(nullif(regexp_extract(title, '^(\d+)[.)]?\s+\S', 1), '') AS INT)"),
    "rest": (lambda: headings.without_number(C()), compact(r"regexp_replace(title, '^\d+[.)]?\s*', '')")),
}, "title IS NOT NULL")
PARTS = "CASE WHEN g THEN NULL WHEN regexp_matches(t, '(?i)^(?:pr[óo]logo|prologue)\\b') THEN 'prologue' WHEN regexp_matches(t, '(?i)^(?:ep[ií]logo|epilogue|épilogue)\\b') THEN 'epilogue' WHEN n IS NOT NULL THEN 'chapter' END"
QUERIES["book_parts"] = lambda spark, sf: table(spark, sf, "sections").where("title IS NOT NULL").select("title", headings.book_part(C()).alias("p")).distinct().select("title", "p.kind", "p.number")
ORACLE["book_parts"] = rf"""
WITH a AS (SELECT DISTINCT title, {compact('title')} AS t FROM sections WHERE title IS NOT NULL),
b AS (SELECT title, t, regexp_matches(t, '(?i)^(?:volume|vol\.|part|parte|arc|arco|book|livro|libro|tome)\b') AS g, coalesce(TRY_CAST(nullif(regexp_extract(t, '(?i)^(?:cap[ií]tulo|chapter|chapitre|cap\.)\s+(\d{{1,4}})(?:\s*[.:—–-]\s*|\s+)(.+)$', 1), '') AS INT),
  TRY_CAST(nullif(regexp_extract(t, '(?i)^(?:cap[ií]tulo|chapter|chapitre)\s+(\d{{1,4}})$', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, '^(\d{{1,4}})[.)]\s+(.+)$', 1), '') AS INT)) AS n FROM a)
SELECT title, kind, CASE WHEN kind = 'chapter' THEN n END AS number FROM (SELECT *, {PARTS} AS kind FROM b)"""
columns("printed_numbers", "sections", "title", {
    "number": (lambda: headings.printed_number(C()), rf"TRY_CAST(nullif(regexp_extract({compact('title')}, '(?i)^(?:cap[ií]tulo|chapter|chapitre)\s+(\d+)', 1), '') AS INT)"),
}, "title LIKE 'Chapter %' OR title LIKE 'Capítulo %' OR title LIKE 'Chapitre %'")
QUERIES["roman_values"] = lambda spark, sf: table(spark, sf, "text_nodes").select(F.explode(text.tokens(F.lower("text"))).alias("word")).where(F.col("word").rlike("^[ivxlcdm]+$")).distinct().select("word", headings.roman(F.col("word")).alias("value"))
ORACLE["roman_values"] = r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}][\p{L}\p{N}''’-]*')) AS word FROM text_nodes),
v AS (SELECT word, list_transform(string_split(word, ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END) AS v FROM w WHERE regexp_matches(word, '^[ivxlcdm]+$'))
SELECT word, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] < coalesce(v[i + 1], 0) THEN -v[i] ELSE v[i] END)) AS INT) AS value FROM v"""
SMALL = ", ".join(f"'{w}'" for w in text.SMALL)


def titled(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({compact(x)}), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ({SMALL}) THEN w ELSE upper(w[1]) || w[2:] END), ' ')"


columns("title_cases", "sections", "title", {"cased": (lambda: text.title_case(C()), titled("title"))}, "title IS NOT NULL")
PREFIX = r"'(?i)^(cap[ií]tulo|chapter|chapitre)\s+(\d{1,4})\s*[.:—–-]?\s*(.*)$'"
SHOWN = f"CASE WHEN regexp_extract({compact('title')}, {PREFIX}, 2) = '' THEN {compact('title')} WHEN regexp_extract({compact('title')}, {PREFIX}, 3) = '' THEN {titled(f'regexp_extract({compact(chr(116) + chr(105) + chr(116) + chr(108) + chr(101))}, {PREFIX}, 1)')} || ' ' || regexp_extract({compact('title')}, {PREFIX}, 2) ELSE {titled(f'regexp_extract({compact(chr(116) + chr(105) + chr(116) + chr(108) + chr(101))}, {PREFIX}, 1)')} || ' ' || regexp_extract({compact('title')}, {PREFIX}, 2) || ': ' || regexp_extract({compact('title')}, {PREFIX}, 3) END"
columns("display_titles", "sections", "title", {"normalized": (lambda: headings.display_title(C())["normalized"], SHOWN), "changed": (lambda: headings.display_title(C())["changed"], f"({SHOWN}) <> {compact('title')}")}, "title IS NOT NULL")
columns("file_names", "sections", "path", {
    "safe": (lambda: text.safe_file_name(F.col("path")), compact(r"""regexp_replace(path, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g')""") + "[1:120]"),
    "sort_key": (lambda: text.natural_key(F.col("path")), r"array_to_string(list_transform(regexp_extract_all(lower(path), '\d+|\D+'), lambda r: CASE WHEN regexp_matches(r, '^\d') THEN lpad(CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END, 12, '0') ELSE r END), '')"),
}, "path IS NOT NULL")
QUERIES["file_ranges"] = lambda spark, sf: table(spark, sf, "books").select("book_id", F.concat_ws("", F.lit("book "), F.lpad(F.col("first_chapter").cast("string"), 3, "0"), F.lit("-"), F.col("last_chapter").cast("string"), F.lit(".epub")).alias("name")).distinct().select("book_id", "name", headings.file_range(F.col("name")).alias("r")).select("book_id", "name", "r.first", "r.last")
ORACLE["file_ranges"] = "SELECT DISTINCT book_id, concat_ws('', 'book ', lpad(CAST(first_chapter AS VARCHAR), 3, '0'), '-', CAST(last_chapter AS VARCHAR), '.epub') AS name, CASE WHEN last_chapter IS NOT NULL THEN first_chapter END AS first, CASE WHEN first_chapter IS NOT NULL THEN last_chapter END AS last FROM books"
CLEANED, QUALITY = without_markup("title"), {}
NGEN = f"(lower({CLEANED}) = '' OR regexp_matches(lower({CLEANED}), '^\\*{{1,5}}$|^[-–—_•·]+$|^cap[ií]tulo\\s*\\d*$') OR regexp_matches(lower({CLEANED}), '{headings.GENERIC_TITLES}'))"
NFILE = f"regexp_matches(lower({CLEANED}), '{headings.FILE_TITLES}')"
NWORDS = f"len(string_split({CLEANED}, ' '))"
NCHAP = f"({CLEANED} <> '' AND NOT {NGEN} AND NOT {NFILE} AND length({CLEANED}) <= 90 AND NOT (regexp_matches({CLEANED}, '[.!?…]') AND {NWORDS} > 5) AND NOT regexp_matches({CLEANED}, '{headings.TOLD}'))"
NFRAG = f"(regexp_matches({CLEANED}, '^[“\"''‘]') OR (regexp_matches({CLEANED}, '[.!?]$') AND {NWORDS} >= 3) OR {NWORDS} > 8)"
columns("title_quality", "sections", "title", {
    "reason": (lambda: headings.title_quality(C())["reason"], f"CASE WHEN {CLEANED} = '' THEN 'EMPTY_TITLE' WHEN {NGEN} THEN 'GENERIC_TITLE' WHEN {NFILE} THEN 'FILENAME_TITLE' WHEN {NFRAG} THEN 'TEXT_FRAGMENT_TITLE' WHEN {NCHAP} THEN 'CHAPTER_PATTERN' ELSE 'UNKNOWN_PATTERN' END"),
    "quality": (lambda: headings.title_quality(C())["quality"], f"CASE WHEN {CLEANED} <> '' AND NOT {NGEN} AND NOT {NFILE} AND NOT {NFRAG} AND {NCHAP} THEN 'valid' ELSE 'invalid' END"),
})
columns("title_scores", "chapters", "title", {
    "score": (lambda: headings.title_score(C()), f"CASE WHEN {NGEN} OR {NFILE} THEN 0 WHEN {NCHAP} THEN 100 WHEN length({CLEANED}) <= 60 AND {NWORDS} <= 6 AND NOT regexp_matches({CLEANED}, '[.!?…]$') THEN 20 ELSE 0 END"),
    "generic": (lambda: headings.is_generic_title(C()), NGEN), "chapter_like": (lambda: headings.is_chapter_title(C()), NCHAP), "file_like": (lambda: headings.is_file_title(C()), NFILE),
})
columns("best_titles", "sections", "section_id", {
    "best": (lambda: headings.best_title(C(), F.col("path")), f"CASE WHEN {NCHAP} OR NOT ({{p}}) THEN title ELSE path END".replace("{p}", "length(path) > 0 AND NOT regexp_matches(lower(path), '\\.(?:xhtml|html)$')")),
}, "title IS NOT NULL AND path LIKE '%.xhtml'")
columns("footnote_lines", "text_nodes", "node_id", {
    "footnote": (lambda: headings.is_footnote_entry(T()), rf"regexp_matches({compact('text')}, '(?i)^\d{{1,4}}[.)]\s+.*(?:\bpp?\.\s*\d|\bed\.|\bvol\.|\bISBN\b|https?://|\(\d{{4}}\))')"),
    "system": (lambda: validate.is_system_block(T()), r"regexp_matches(trim(text), '^[\[【〔].+[\]】〕]$')"),
}, "text IS NOT NULL")
columns("sibling_titles", "chapters", "title", {
    "sibling": (lambda: headings.is_sibling_title(C()), rf"length({compact('title')}) BETWEEN 2 AND 140 AND NOT regexp_matches({compact('title')}, '(?i)^(?:cap[ií]tulo|chapter|chapitre|cap\.)\s+0*[1-9]\d*(?:\s*[.:—–-]\s*|\s+)(.+)$|^0*[1-9]\d*[.)]\s+(.+)$') AND NOT regexp_matches({compact('title')}, '[.;,]$')"),
}, "title IS NOT NULL")

# Hashes, shares, similarities --------------------------------------------------------------------------------------------
columns("short_hashes", "chunks", "chunk_id", {
    "short": (lambda: text.short_hash(Q()), "md5(" + compact(f"regexp_replace(coalesce(output_text, ''), '{CONTROLS}', '', 'g')") + ")[1:8]"),
    "cache_key": (lambda: text.cache_key(F.col("instruction"), Q()), "md5(coalesce(instruction, '')[1:500] || '|' || coalesce(output_text, '')[1:500])"),
})
QUERIES["share_percent"] = lambda spark, sf: table(spark, sf, "documents").groupBy("source").agg(text.percent(F.count("lang"), F.count("*")).alias("percent"))
ORACLE["share_percent"] = "SELECT source, round(100 * count(lang) / count(*)) AS percent FROM documents GROUP BY source"
X, Y = rf"list_distinct(regexp_extract_all({fold('instruction')}, '\p{{L}}+'))", rf"list_distinct(regexp_extract_all({fold('output_text')}, '\p{{L}}+'))"
columns("token_overlaps", "chunks", "chunk_id", {
    "containment": (lambda: F.round(similarity.containment(text.letter_set(F.col("instruction")), text.letter_set(Q())), 6), f"CASE WHEN len({Y}) > 0 THEN round(len(list_intersect({X}, {Y})) / len({Y}), 6) ELSE 0.0 END"),
    "overlap": (lambda: F.round(similarity.overlap(text.letter_set(F.col("instruction")), text.letter_set(Q())), 6), f"CASE WHEN least(len({X}), len({Y})) > 0 THEN round(len(list_intersect({X}, {Y})) / least(len({X}), len({Y})), 6) ELSE 0.0 END"),
})
RATIO = f"length({compact('original_name')}) / length({compact('canonical')})"
columns("length_similarities", "entities", "canonical, original_name", {
    "alike": (lambda: F.round(similarity.length_similarity(F.col("canonical"), F.col("original_name")), 6), f"CASE WHEN length({compact('canonical')}) = 0 OR length({compact('original_name')}) = 0 OR {RATIO} < 0.45 OR {RATIO} > 2.4 THEN 0.0 ELSE round(least({RATIO}, 1 / ({RATIO})), 6) END"),
    "ratio": (lambda: F.round(similarity.length_ratio(F.col("canonical"), F.col("original_name")), 6), f"CASE WHEN length({compact('canonical')}) = 0 OR length({compact('original_name')}) = 0 THEN 1.0 ELSE round({RATIO}, 6) END"),
})

# Model text --------------------------------------------------------------------------------------------------------------
THINK = r"(?i)</?(?:think|thinking|reasoning)>"
PRE = model_text.PREAMBLE.replace("(?iu)", "(?i)").replace("'", "''")
LABEL = model_text.LABEL.replace("(?iu)", "(?i)")
NO_THINK = "regexp_replace(coalesce(output_text, ''), '(?is)<(?:think|thinking|reasoning)>.*?(?:</(?:think|thinking|reasoning)>|$)', '', 'g')"
columns("model_output_clean", "chunks", "chunk_id", {
    "digest": (lambda: F.md5(model_text.clean_output(Q())), rf"md5(trim(regexp_replace(regexp_replace(trim(regexp_replace({NO_THINK}, '(?m)^\s*```\w*\s*$', '', 'g'), ' '), '{PRE}', ''), '{LABEL}', ''), ' '))"),
    "thinking": (lambda: model_text.has_thinking(Q()), f"regexp_matches(coalesce(output_text, ''), '{THINK}')"),
    "preamble": (lambda: model_text.has_preamble(Q()), f"regexp_matches(coalesce(output_text, ''), '{PRE}') OR regexp_matches(coalesce(output_text, ''), '{LABEL}')"),
})
columns("quoted_options", "chunks", "instruction", {
    "options": (lambda: F.array_join(F.array_sort(model_text.quoted_options(F.col("instruction"))), "|"), f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(instruction, ''), '[\"“''‘]([^\"”''’“‘]{{1,80}})[\"”''’]', 1), lambda x: {compact('x')}))), '|')"),
})
GENDER = {"he": "she", "his": "her", "him": "her"}
columns("gendered_words", "text_nodes", "node_id", {
    "changed": (lambda: model_text.by_dictionary(text.key_text(T()), GENDER), f"array_to_string(list_transform(string_split({key_text('text')}, ' '), lambda w: CASE w WHEN 'he' THEN 'she' WHEN 'his' THEN 'her' WHEN 'him' THEN 'her' ELSE w END), ' ')"),
})
RESIDUAL = ["the", "and", "los", "les", "não"]
columns("residual_words", "chunks", "chunk_id", {
    "left_over": (lambda: F.array_join(F.array_sort(model_text.residual_terms(Q(), RESIDUAL)), " "), f"array_to_string(list_sort(list_filter([{', '.join(map(repr, RESIDUAL))}], lambda t: list_contains(regexp_extract_all(lower(coalesce(output_text, '')), '[\\p{{L}}'']+'), t))), ' ')"),
})
NAMES = r"list_filter(list_distinct(regexp_extract_all(coalesce({}, ''), '(?:^|[^\p{{L}}\p{{N}}])(\p{{Lu}}[\p{{L}}\p{{N}}''-]{{2,}})', 1)), lambda x: x NOT IN (" + ", ".join(repr(w) for w in text.NO_NAMES) + "))"
NUMS = r"list_distinct(regexp_extract_all(coalesce({}, ''), '\d+(?:[.,]\d+)?'))"
columns("token_reports", "chunks", "chunk_id", {
    "names_lost": (lambda: big(F.size(model_text.token_report(F.col("instruction"), Q())["names_lost"])), f"len(list_filter({NAMES.format('instruction')}, lambda x: NOT list_contains({NAMES.format('output_text')}, x)))"),
    "names_added": (lambda: big(F.size(model_text.token_report(F.col("instruction"), Q())["names_added"])), f"len(list_filter({NAMES.format('output_text')}, lambda x: NOT list_contains({NAMES.format('instruction')}, x)))"),
    "numbers_lost": (lambda: big(F.size(model_text.token_report(F.col("instruction"), Q())["numbers_lost"])), f"len(list_filter({NUMS.format('instruction')}, lambda x: NOT list_contains({NUMS.format('output_text')}, x)))"),
    "missing_names": (lambda: F.array_join(F.array_sort(model_text.missing_names(F.col("instruction"), Q())), "|"), f"array_to_string(list_sort(list_filter({NAMES.format('instruction')}, lambda x: NOT contains({fold('output_text')}, {fold('x')}))), '|')"),
})
A_SET, B_SET = rf"list_distinct(regexp_extract_all({fold('canonical')}, '\p{{L}}+'))", rf"list_distinct(regexp_extract_all({fold('original_name')}, '\p{{L}}+'))"
GROWTH = f"length({compact('original_name')}) / greatest(length({compact('canonical')}), 1)"
columns("suggestion_verdicts", "entities", "canonical, original_name", {
    "reason": (lambda: model_text.suggestion_verdict(F.col("canonical"), F.col("original_name"), F.lit(0.9))["reason"],
        f"CASE WHEN {compact('original_name')} = '' THEN 'empty' WHEN {GROWTH} < 0.45 OR {GROWTH} > 1.8 THEN 'length' WHEN len(list_filter({NUMS.format('canonical')}, lambda x: NOT list_contains({NUMS.format('original_name')}, x))) > 0 THEN 'numbers_changed' "
        f"WHEN len(list_filter({NAMES.format('canonical')}, lambda x: NOT list_contains({NAMES.format('original_name')}, x))) > 0 THEN 'names_changed' WHEN CASE WHEN least(len({A_SET}), len({B_SET})) > 0 THEN len(list_intersect({A_SET}, {B_SET})) / least(len({A_SET}), len({B_SET})) ELSE 0.0 END < 0.58 THEN 'rewritten' END"),
})

# Gates -------------------------------------------------------------------------------------------------------------------
FRONT = "(?i)(?:cover|capa|title|rosto|copyright|cr[eé]dit|toc|nav|index|[ií]ndice|sum[aá]rio|dedicat|prefac|about|colophon)"
front = lambda: validate.is_front_matter(F.col("path"), C(), F.col("char_count"), F.lit("yes"))
IS_FRONT = f"(coalesce(regexp_matches(path, '{FRONT}'), false) OR coalesce(regexp_matches(title, '{FRONT}'), false) AND char_count < 2000)"
columns("document_roles", "sections", "section_id", {
    "front": (front, IS_FRONT),
    "role": (lambda: validate.document_role(front(), F.col("chapter_number").isNotNull(), F.col("char_count")), f"CASE WHEN {IS_FRONT} THEN 'frontmatter' WHEN chapter_number IS NOT NULL AND char_count < 200 THEN 'broken-chapter' WHEN chapter_number IS NOT NULL THEN 'chapter' ELSE 'ignored' END"),
    "textual": (lambda: validate.is_textual(F.lit("x"), F.col("path")), r"regexp_matches(path, '(?i)\.x?html?(?:[#?].*)?$')"),
})
REASON = "CASE WHEN trim(coalesce(from_text, '')) = '' THEN 'missing_before' WHEN trim(coalesce(to_text, '')) = '' THEN 'missing_after' WHEN from_text = to_text THEN 'no_change' WHEN coalesce(apply_mode, '') <> 'auto_safe' THEN 'not_auto_safe' WHEN CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END < 0.9 THEN 'low_confidence' END"
columns("skip_reasons", "terms", "term_id", {
    "reason": (lambda: validate.skip_reason(F.col("apply_mode"), F.col("confidence"), F.col("from_text"), F.col("to_text")), REASON),
    "review": (lambda: validate.needs_review(F.col("apply_mode")), "apply_mode IN ('auto_review', 'manual_only')"),
})
QUERIES["gate_counts"] = lambda spark, sf: (lambda passed, skipped: passed.agg(F.count("*").alias("n")).select(F.lit("passed").alias("reason"), "n").unionByName(skipped.groupBy("reason").agg(F.count("*").alias("n"))))(*validate.gate(table(spark, sf, "terms"), validate.skip_reason(F.col("apply_mode"), F.col("confidence"), F.col("from_text"), F.col("to_text"))))
ORACLE["gate_counts"] = f"SELECT coalesce(r, 'passed') AS reason, count(*) AS n FROM (SELECT {REASON} AS r FROM terms) GROUP BY 1"
