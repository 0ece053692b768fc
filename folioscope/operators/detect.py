"""Detectors: each takes frames and returns findings of one schema (see ``findings``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.similarity import dice, edit_similarity, length_ratio, repeated_run, said_twice
from folioscope.functions.text import clean_word, comparable, compact, fold, letter_set, long_tokens, numbers, proper_names, punctuation_profile, telling_numbers, text_or_empty, tokens
from folioscope.operators.findings import finding, longest_phrases, missing_items, union_all
from folioscope.operators.match import glossary_hits

#: A rule table: name, pattern, least number of hits, severity.
Rule = tuple[str, str, int, str]

MARKUP: list[Rule] = [("residual_markup", r"(?i)</?[a-z][a-z0-9]*[^<>]*>", 1, "FAIL"), ("residual_entities", r"(?i)&[a-z]+;", 6, "WARN")]
PUNCTUATION: list[Rule] = [("space_before_punctuation", r"\s[,.;:!?](?:\s|$)", 1, "WARN"), ("no_space_after_punctuation", r"[,;:!?]\p{L}", 6, "WARN"), ("repeated_punctuation", r"[,;:]{2,}", 1, "WARN")]
STYLE: list[Rule] = [("straight_quotes", '"', 1, "INFO"), ("double_spaces", " {2,}", 11, "INFO"), ("ellipsis_overuse", r"\.{3}|…", 6, "INFO")]
FORMAT: list[Rule] = [("multiple_spaces", " {3,}", 11, "WARN"), ("long_lines", r"(?m)^.{201,}$", 1, "INFO")]
#: Function words that mark a language.
MARKERS = {
    "en": "the and with was were that this from into her his they their".split(), "pt": "não uma com para mais pela pelo você então também".split(),
    "es": "los las una con para más pero había está también".split(), "fr": "les des une dans pour avec était cette mais sans".split(),
}
#: Portuguese forms of address (folded).
INFORMAL, FAMILIAR, FORMAL = r"\b(?:voce|voces)\b", r"\b(?:tu|teu|tua|teus|tuas|contigo)\b", r"\b(?:o senhor|a senhora|vossa|vosso)\b"


def by_rules(df: DataFrame, unit: str, text: str, rules: list[Rule]) -> DataFrame:
    """One finding a rule that hits often enough; all rules are counted in one pass over the text."""
    hits = [F.struct(F.lit(n).alias("type"), F.lit(s).alias("severity"), F.lit(m).alias("least"), F.regexp_count(text_or_empty(F.col(text)), F.lit(p)).alias("hits")) for n, p, m, s in rules]
    rows = df.select(unit, F.explode(F.array(*hits)).alias("x")).where("x.hits >= x.least")
    return finding(rows, F.col(unit), F.col("x.type"), F.col("x.severity"), F.col("x.hits"))


def section_findings(aligned: DataFrame, unit: Column, source: str, target: str, source_paragraphs: str, target_paragraphs: str) -> DataFrame:
    """Missing and extra sections, and matched ones that are too short in characters or paragraphs."""
    gone = finding(aligned.where("match_type = 'missing'"), unit, "missing_sections", "FAIL")
    extra = finding(aligned.where("match_type = 'extra'"), unit, "extra_sections", "WARN")
    m = aligned.where((F.col("match_type") == "matched") & (F.col(source) >= 800))
    r = F.round(F.col(target) / F.greatest(F.col(source), F.lit(1)), 3)
    p = F.col(target_paragraphs) / F.greatest(F.col(source_paragraphs), F.lit(1))
    short = finding(m.where(r < 0.35), unit, "section_too_short", "FAIL", detail=r)
    shortish = finding(m.where((r >= 0.35) & (r < 0.55)), unit, "section_short", "WARN", detail=r)
    few = finding(m.where((p < 0.35) & (F.col(source_paragraphs) >= 10)), unit, "paragraph_count_low", "WARN", detail=F.round(p, 3))
    return union_all(gone, extra, short, shortish, few)


def document_ratio(df: DataFrame, unit: str, source: str, target: str) -> DataFrame:
    r = F.col(target) / F.greatest(F.col(source), F.lit(1))
    kind = F.when(r < 0.55, "translation_too_short").when(r > 1.65, "translation_too_long")
    return finding(df.where(kind.isNotNull()), F.col(unit), kind, F.when(r < 0.55, "FAIL").otherwise("WARN"), detail=F.round(r, 3))


def residual_blocks(df: DataFrame, unit: str, text: str, source_lang: str, target_lang: str, least_chars: int = 120, least_hits: int = 8) -> DataFrame:
    """Paragraphs that are still in the source language."""
    count = lambda lang: F.regexp_count(F.lower(F.col(text)), F.lit(r"(?u)(?<![\p{L}])(?:" + "|".join(MARKERS[lang]) + r")(?![\p{L}])"))
    a, b = count(source_lang), count(target_lang)
    return finding(df.where((F.length(text) >= least_chars) & (a >= least_hits) & (a > b)), F.col(unit), F.lit(f"residual_{source_lang}_block"), "WARN", a)


def log_findings(log: DataFrame, key: str, source_text: str, target_text: str) -> DataFrame:
    """Replacements of a translation log that the texts do not bear out."""
    from folioscope.functions.text import has_term

    in_source, old, new = has_term(F.col(source_text), F.col("from_text")), has_term(F.col(target_text), F.col("from_text")), has_term(F.col(target_text), F.col("to_text"))
    kind = F.when(old, "old_form_present").when(in_source & ~new, "new_form_missing")
    return finding(log.where(kind.isNotNull()), F.col(key), kind, "WARN", detail=F.concat_ws(" -> ", "from_text", "to_text"))


def repetition_findings(df: DataFrame, unit: str, text: str) -> DataFrame:
    words = df.select(unit, F.split(compact(F.col(text)), r"(?<=[.!?])\s+").alias("_parts"), long_tokens(F.col(text)).alias("_words"))
    twice = said_twice(F.col("_parts"))
    said = F.when(F.size(long_tokens(twice)) >= 4, twice)
    # An explode, not a filter: a filter would be pushed below the columns and cut the text anew at every place.
    r = words.select(unit, F.explode(F.array_compact(F.array(F.coalesce(said, repeated_run(F.col("_words")))))).alias("r"))
    return finding(r, F.col(unit), "repetition_anomaly", F.when(F.length("r") > 80, "high").otherwise("medium"), detail=F.substring("r", 1, 180))


def treatment_findings(df: DataFrame, unit: str, text: str, informal: str = INFORMAL, familiar: str = FAMILIAR, formal: str = FORMAL) -> DataFrame:
    """Two ways of address inside the quotes of one paragraph."""
    q = fold(F.array_join(F.regexp_extract_all(text_or_empty(F.col(text)), F.lit("[\"“«][^\"”»]{8,}[\"”»]"), 0), " "))
    kind = F.when(q.rlike(informal) & q.rlike(familiar), "informal and familiar").when(q.rlike(informal) & q.rlike(formal), "informal and formal")
    return finding(df.select(unit, kind.alias("k")).where("k IS NOT NULL"), F.col(unit), "treatment_inconsistency", "medium", detail=F.col("k"))


def terminology_findings(df: DataFrame, glossary: DataFrame, unit: str, text: str) -> DataFrame:
    """The first glossary term (in glossary order) whose old form is still in a paragraph."""
    g = glossary.where("from_text IS NOT NULL AND to_text IS NOT NULL")
    hits = glossary_hits(df, g, [unit], text).join(g.groupBy(F.col("from_text").alias("term")).agg(F.min("term_id").alias("term_id"), F.max(F.nanvl("confidence", F.lit(None).cast("double"))).alias("confidence")), "term")
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy(unit).orderBy("term_id"))).where("_r = 1")
    return finding(first, F.col(unit), "terminology_inconsistency", F.when(F.col("confidence") >= 0.9, "medium").otherwise("low"), F.col("hits"), F.col("term"))


def pair_findings(pairs: DataFrame, unit: str, source: str, target: str, entities: Column | None = None) -> DataFrame:
    """What a pair of aligned paragraphs shows: omission or expansion, lost numbers, drifting names, punctuation."""
    s, t = F.col(source), F.col(target)
    r = length_ratio(s, t)
    lengths = finding(pairs.where((r < 0.58) | (r > 2.1)), F.col(unit), "omission_or_expansion", F.when((r < 0.42) | (r > 2.7), "high").otherwise("medium"), detail=F.round(r, 2))
    lost = F.array_except(telling_numbers(s), telling_numbers(t))
    nums = finding(pairs.where(F.size(lost) > 0), F.col(unit), "number_missing", "high", F.size(lost), F.array_join(F.array_sort(lost), ","))
    names = proper_names(s) if entities is None else F.array_intersect(proper_names(s), entities)
    gone = missing_items(F.slice(names, 1, 8), t)
    drift = finding(pairs.where(F.size(gone) >= 2), F.col(unit), "entity_drift", "medium", F.size(gone), F.array_join(F.array_sort(gone), ","))
    p, q = punctuation_profile(s), punctuation_profile(t)
    marks = finding(pairs.where((p["question"] != q["question"]) | (p["exclamation"] != q["exclamation"])), F.col(unit), "dialogue_punctuation_drift", "low")
    return union_all(lengths, nums, drift, marks)


def title_findings(titles: DataFrame, unit: str, title: str, expected: str) -> DataFrame:
    """Titles unlike the expected translation in letters, length and words."""
    a, b = comparable(F.col(title)), comparable(F.col(expected))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    unlike = (edit_similarity(a, b) < 0.35) & (ratio < 0.65) & (F.size(F.array_intersect(letter_set(a), letter_set(b))) == 0)
    return finding(titles.where((a != "") & (b != "") & unlike), F.col(unit), "title_mismatch", "WARN", detail=F.col(title))


def coverage_findings(pairs: DataFrame, unit: str, source: str, target: str) -> DataFrame:
    """Chapters missing, much shorter, or without numbers and names of the other edition."""
    s, t = F.col(source), F.col(target)
    gone = finding(pairs.where(t.isNull() & s.isNotNull()), F.col(unit), "chapter_missing", "FAIL")
    both = pairs.where(s.isNotNull() & t.isNotNull())
    r = F.length(compact(t)) / F.greatest(F.length(compact(s)), F.lit(1))
    short = finding(both.where((F.length(compact(s)) > 3_000) & (r < 0.45)), F.col(unit), "chapter_short", "FAIL", detail=F.round(r, 3))
    lost = F.array_except(telling_numbers(s), telling_numbers(t))
    nums = finding(both.where(F.size(lost) > 0), F.col(unit), "numbers_missing", "WARN", F.size(lost), F.array_join(F.slice(F.array_sort(lost), 1, 5), ","))
    names = missing_items(proper_names(s), t)
    gone_names = finding(both.where(F.size(names) >= 4), F.col(unit), "names_missing", "WARN", F.size(names))
    return union_all(gone, short, nums, gone_names)


def foreign_terms(df: DataFrame, unit: str, text: str, markers: list[str]) -> DataFrame:
    """Marker phrases of another language in a block, longest ones only."""
    found = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.concat(F.lit(" "), comparable(F.col(text)), F.lit(" ")), F.concat(F.lit(" "), m, F.lit(" "))))
    rows = df.select(unit, longest_phrases(found).alias("p")).where(F.size("p") > 0)
    return finding(rows, F.col(unit), "residual_phrase", "WARN", F.size("p"), F.array_join("p", ","))


def ending_findings(df: DataFrame, unit: str, text: str) -> DataFrame:
    """Ends that look cut: dots, a letter, a comma; and a very short last line."""
    t = F.regexp_replace(F.substring(text_or_empty(F.col(text)), -50, 50), r"\s+\z", "")
    kind = F.when(t.rlike(r"\.\.\.\z"), "ends_with_dots").when(t.rlike(r"(?i)[a-z]\z"), "ends_with_letter").when(t.rlike(r",\z"), "ends_with_comma")
    last = F.try_element_at(F.filter(F.split(text_or_empty(F.col(text)), "\n"), lambda x: F.trim(x) != ""), F.lit(-1))
    lines = F.size(F.filter(F.split(text_or_empty(F.col(text)), "\n"), lambda x: F.trim(x) != ""))
    cut = finding(df.where(kind.isNotNull()), F.col(unit), kind, "WARN")
    short = finding(df.where((F.length(last) < 30) & (lines > 3)), F.col(unit), "short_last_line", "INFO", F.length(last))
    return cut.unionByName(short)


def balance_findings(df: DataFrame, unit: str, text: str) -> DataFrame:
    """Parentheses and quotes that do not balance."""
    n = lambda p: F.regexp_count(text_or_empty(F.col(text)), F.lit(p))
    parens = finding(df.where(n(r"\(") != n(r"\)")), F.col(unit), "unmatched_parentheses", "WARN", F.abs(n(r"\(") - n(r"\)")))
    quotes = finding(df.where(F.abs(n("[“«]") - n("[”»]")) > 2), F.col(unit), "unmatched_quotes", "WARN", F.abs(n("[“«]") - n("[”»]")))
    return parens.unionByName(quotes)


def boundary_findings(pairs: DataFrame, unit: str, source: str, target: str, kind: str = "first_paragraph_mismatch") -> DataFrame:
    """First (or last) paragraphs that share few letters pairs although both are long."""
    s, t = F.col(source), F.col(target)
    return finding(pairs.where((F.length(s) > 30) & (F.length(t) > 30) & (dice(s, t) < 0.3)), F.col(unit), kind, "WARN", detail=F.round(dice(s, t), 3))


def name_variants(names: DataFrame, block: list[str], name: str, count: str, alike: float = 0.78, gap: int = 6, total: int = 4) -> DataFrame:
    """Groups of spellings of one name within a block: the most frequent leads, the others join in order of frequency.

    Candidates come from a pigeonhole segment join within the block, which is complete for the similarity: of the longer
    name (length L) cut into k+1 segments, k = (1 - alike) * L, the first that is unchanged after as many edits as there are
    segments before it stands in the shorter name, shifted by at most those edits, and on its right by at most the edits left.
    The greedy choice runs over the few candidates. Rows grow where names are cut, behind the planner's estimate, so no side
    of these joins may be broadcast.
    """
    rows = names.select(*block, F.col(name).alias("name"), F.col(count).alias("n"), F.regexp_replace(comparable(F.col(name)), " ", "").alias("_low")).where("name IS NOT NULL AND _low != ''")
    kinds = ", ".join(f"`{c}` {names.schema[c].dataType.simpleString()}" for c in block)
    size, length, part = F.length("_low"), F.col("_length"), F.col("_part")
    k = F.floor((1 - alike) * length + 1e-9).cast("int")
    start, end = (F.floor((part + x) * length / (k + 1)).cast("int") for x in (0, 1))
    cut = lambda d: d.withColumn("_part", F.explode(F.sequence(F.lit(0), k)))
    index = cut(rows.withColumn("_length", size)).select(*block, "_length", "_part", F.substring(F.col("_low"), start + 1, end - start).alias("_segment"), F.col("name").alias("_long"))
    probe = cut(rows.withColumn("_length", F.explode(F.sequence(size, F.least(F.floor(size / alike + 1e-9).cast("int"), size + gap)))))
    first = F.greatest(start + F.greatest(-part, size - length - (k - part)), F.lit(0))
    last = F.least(start + F.least(part, size - length + (k - part)), size - (end - start))
    segments = F.array_distinct(F.transform(F.sequence(first, last), lambda at: F.substring(F.col("_low"), at + 1, end - start)))
    probe = probe.where(first <= last).select(*block, "_length", "_part", F.explode(segments).alias("_segment"), F.col("name").alias("_short"))
    found = probe.join(index.hint("merge"), [*block, "_length", "_part", "_segment"]).where("_long != _short").select(*block, F.explode(F.array(F.struct(F.col("_long").alias("x"), F.col("_short").alias("y")), F.struct(F.col("_short").alias("x"), F.col("_long").alias("y")))).alias("_p"))
    found = found.select(*block, F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y")).distinct()
    a, b = (rows.select(*block, F.col("name").alias(k_), F.struct("name", "n", F.col("_low").alias("low")).alias(s_)).hint("merge") for k_, s_ in (("_x", "a"), ("_y", "b")))
    near = found.join(a, [*block, "_x"]).join(b, [*block, "_y"]).where("a.n > b.n OR (a.n = b.n AND a.name < b.name)").where(F.abs(F.length("a.low") - F.length("b.low")) <= gap)
    near = near.where(edit_similarity(F.col("a.low"), F.col("b.low")) >= alike)
    near = near.select(*block, F.col("a.name").alias("lead"), F.col("a.n").alias("lead_n"), F.col("b.name").alias("variant"), F.col("b.n").alias("variant_n"))

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for r in f.sort_values(["lead_n", "lead", "variant_n", "variant"], ascending=[False, True, False, True]).itertuples(index=False):
            if r.lead not in taken and r.variant not in taken:
                taken.add(r.variant)
                out.append(r)
        return pd.DataFrame(out, columns=f.columns)

    chosen = near.groupBy(*block).applyInPandas(choose, f"{kinds}, lead string, lead_n bigint, variant string, variant_n bigint")
    group = F.col("lead_n") + F.sum("variant_n").over(Window.partitionBy(*block, "lead"))
    return chosen.withColumn("_group", group).where(F.col("_group") >= total).drop("_group")


def residual_vocabulary(source: DataFrame, target: DataFrame, key: list[str], unit: str, text: str, markers: list[str], common: list[str], rare: int = 25, known: int = 12, least: int = 4) -> DataFrame:
    """Words of the source text that were left in the translated text of the same document.

    A word counts if it is a marker of the source language, or if it is rare in the source (at most ``rare``), not usual in
    the translation (at most ``known``), no common word of the target language and no name.
    """
    words = lambda d, *c: d.select(*key, *c, F.explode(tokens(F.col(text))).alias("_w")).withColumn("token", clean_word(F.col("_w"))).where(F.length("token") >= least)
    s = words(source).groupBy(*key, "token").agg(F.count("*").alias("_s"), F.bool_or(F.col("_w").rlike(r"^\p{Lu}")).alias("_name"))
    t = words(target, unit)
    usual = t.groupBy(*key, "token").agg(F.count("*").alias("_t"))
    marker = F.col("token").isin(markers)
    kept = s.join(usual, [*key, "token"]).where(~F.col("token").isin(common)).where(marker | (~F.col("_name") & (F.col("_s") <= rare) & (F.col("_t") <= known)))
    hits = t.join(kept.select(*key, "token", marker.alias("_marker")), [*key, "token"]).groupBy(unit).agg(F.count_distinct("token").alias("n"), F.array_join(F.array_sort(F.collect_set("token")), ",").alias("d"), F.bool_or("_marker").alias("m"))
    return finding(hits, F.col(unit), "residual_source_word", F.when(F.col("m"), "high").otherwise("medium"), F.col("n"), F.col("d"))


def terms_in_both(source: DataFrame, target: DataFrame, glossary: DataFrame, key: list[str], unit: str, order: str, text: str, most: int = 6) -> DataFrame:
    """Foreign glossary terms that stand in both editions of a document: the first ``most`` (a report's length) sections each."""
    a = glossary_hits(source, glossary, key, text).select(*key, "term")
    b = glossary_hits(target, glossary, [*key, unit, order], text).join(a, [*key, "term"], "left_semi")
    n = F.row_number().over(Window.partitionBy(*key, "term").orderBy(order, unit))
    rows = b.withColumn("_n", n).where(F.col("_n") <= most)
    return finding(rows, F.col(unit), "foreign_term_in_both", "medium", F.col("hits"), F.col("term"))


def structure_findings(books: DataFrame, unit: str) -> DataFrame:
    """Coded checks of a book's structure over columns opf_path, html_items, spine_items, chapters, has_ncx, metadata_language,
    detected_language, missing_chapters, canonical, expected_chapters, broken, invalid_titles, suspicious_titles.

    Codes are fixed values. With a canonical map, missing chapters and broken documents are not reported, its count is.
    """
    c = F.col
    none = lambda x: F.coalesce(c(x), F.lit(0)) == 0
    some = lambda x: F.coalesce(c(x), F.lit(0)) > 0
    mapped = F.coalesce(c("canonical"), F.lit(False))
    base = lambda x: F.regexp_extract(F.lower(F.coalesce(c(x), F.lit(""))), "^[a-z]+", 0)
    checks = [
        ("MISSING_OPF", "error", F.trim(F.coalesce(c("opf_path"), F.lit(""))) == ""), ("NO_HTML", "error", none("html_items")), ("NO_SPINE", "error", none("spine_items")),
        ("NO_CHAPTERS", "error", none("chapters")), ("NO_NCX_SOURCE", "warning", ~F.coalesce(c("has_ncx"), F.lit(False))), ("LANGUAGE_MISMATCH", "warning", base("metadata_language") != base("detected_language")),
        ("MISSING_CHAPTERS", "error", some("missing_chapters") & ~mapped), ("CANONICAL_COUNT_MISMATCH", "warning", mapped & (c("chapters") != c("expected_chapters"))),
        ("BROKEN_CHAPTERS", "error", some("broken") & ~mapped), ("INVALID_TITLES", "warning", some("invalid_titles")), ("SUSPICIOUS_TITLES", "warning", some("suspicious_titles")),
    ]
    rows = F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(n).alias("code"), F.lit(level).alias("level"))) for n, level, hit in checks)))
    return books.select(unit, F.explode(rows).alias("x")).select(F.col(unit).cast("string").alias("unit"), "x.code", "x.level")


def acronyms(df: DataFrame, unit: str, text: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text_or_empty(F.col(text)), F.lit(r"(?<![\p{L}\p{N}])[A-Z]{2,6}(?![\p{L}\p{N}])"), 0)))
    return finding(df.select(unit, found.alias("a")).where(F.size("a") > 0), F.col(unit), "acronym", "INFO", F.size("a"), F.array_join("a", ","))


def pronoun_findings(sentences: DataFrame, unit: str, text: str, names: Column, markers: list[str], others: Column) -> DataFrame:
    """Markers of one gender nearer to a name of the other than to a name of their own."""
    from folioscope.functions.similarity import closest_distance

    words = F.transform(tokens(F.col(text)), lambda w: fold(w))
    marks = F.array(*map(F.lit, markers))
    own, other = closest_distance(words, names, marks), closest_distance(words, others, marks)
    return finding(sentences.where(own.isNotNull() & (other.isNull() | (own < other))), F.col(unit), "pronoun_mismatch", "medium", detail=own)


def package_findings(entries: DataFrame, unit: str, name: str, text: str, language: str | None = None) -> DataFrame:
    """Markup of package members: unclosed documents, a missing namespace, a missing or other language."""
    t = F.col(text)
    page = entries.where(F.col(name).rlike(r"(?i)\.x?html?$"))
    out = [
        finding(page.where(~t.rlike(r"(?is)</html>\s*$")), F.col(unit), "xml_unclosed", "FAIL", detail=F.col(name)),
        finding(page.where(~t.contains("http://www.w3.org/1999/xhtml")), F.col(unit), "namespace_missing", "FAIL", detail=F.col(name)),
        finding(page.where(~t.rlike(r"(?i)<h[1-6]\b")), F.col(unit), "heading_missing", "WARN", detail=F.col(name)),
    ]
    if language:
        lang = F.regexp_extract(t, r"(?i)<html[^>]*\blang=[\"']([^\"']+)", 1)
        out.append(finding(page.where((lang == "") | ~F.lower(lang).startswith(language)), F.col(unit), "language_wrong", "WARN", detail=lang))
    return union_all(*out)


def shared_numbers(a: Column, b: Column) -> Column:
    return F.array_intersect(numbers(a), numbers(b))
