"""Headings and titles: parsers, scores, predicates, ranges in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import compact, fold, title_case, without_markup

# What counts as a heading, and where a section's number stands in title and path.
PREFIX = r"(?iu)^(cap[ií]tulo|chapter|chapitre|cap\.)\s+(\d{1,4})(?:\s*[.:—–-]\s*|\s+)(.+)$"
NUMBERED = r"^(\d{1,4})[.)]\s+(.+)$"
SECTION_NUMBERS = (r"(?iu)(?:chapter|cap[ií]tulo|chapitre)[_\s-]*0*(\d{1,4})", r"(?i)Text/0*(\d{1,4})[_-]", r"/0*(\d{1,4})[_-]")
#: Portuguese number words.
NUMBER_WORDS = {w: i for i, w in enumerate("zero um dois tres quatro cinco seis sete oito nove dez onze doze treze quatorze quinze dezesseis dezessete dezoito dezenove vinte".split())}
NUMBER_WORDS |= {"uma": 1, "duas": 2, "catorze": 14, "trinta": 30, "quarenta": 40, "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90, "cem": 100, "cento": 100, "duzentos": 200, "trezentos": 300, "quatrocentos": 400, "quinhentos": 500}


def some(c: Column) -> Column:
    return F.when(c != "", c)


def leading_number(c: Column) -> Column:
    """Number of a title such as ``12. The gate`` or ``12 The gate``."""
    return F.regexp_extract(c, r"^(\d+)[.)]?\s+\S", 1).try_cast("int")


def without_number(c: Column) -> Column:
    return compact(F.regexp_replace(c, r"^\d+[.)]?\s*", ""))


def number_of_section(title: Column, path: Column) -> Column:
    """Chapter number from title and path; the first of three patterns that fits."""
    value = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(path, F.lit("")))
    return F.coalesce(*(F.regexp_extract(value, p, 1).try_cast("int") for p in SECTION_NUMBERS))


def parse_heading(c: Column, tag: Column | None = None, in_sequence: Column | None = None) -> Column:
    """``struct<matched, number, title, display, format, score, confidence, reasons>`` of a heading."""
    t = compact(c)
    prefixed, numbered = t.rlike(PREFIX), t.rlike(NUMBERED)
    number = F.when(prefixed, F.regexp_extract(t, PREFIX, 2)).when(numbered, F.regexp_extract(t, NUMBERED, 1)).try_cast("int")
    title = compact(F.when(prefixed, F.regexp_extract(t, PREFIX, 3)).when(numbered, F.regexp_extract(t, NUMBERED, 2)))
    kind = F.when(prefixed, "explicit-prefix").when(numbered, "numbered-punctuation")
    matched = kind.isNotNull() & (number > 0) & (title != "")
    name = F.lower(F.coalesce(tag, F.lit("")) if tag is not None else F.lit(""))
    sequence = F.coalesce(in_sequence, F.lit(False)) if in_sequence is not None else F.lit(False)
    parts = [
        (prefixed, 40, "explicit-prefix"), (~prefixed & numbered, 30, "numbered-punctuation"), (F.lit(True), 20, "valid-number"),
        (name.isin("h1", "h2"), 15, "heading-tag"), (name.isin("h3", "p"), 10, "block-tag"), (name.isin("div", "strong", "b"), 6, "secondary-tag"), (name == "span", 3, "inline-tag"),
        (F.length(title).between(2, 140), 5, "non-empty-title"), (sequence, 10, "sequence"),
    ]
    score = sum((F.when(c, F.lit(n)).otherwise(F.lit(0)) for c, n, _ in parts), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, _, r in parts)))
    found = F.struct(
        F.lit(True).alias("matched"), number.alias("number"), title.alias("title"), F.concat(number.cast("string"), F.lit(". "), title).alias("display"),
        kind.alias("format"), score.alias("score"), F.round(F.least(score / 90, F.lit(1.0)), 2).alias("confidence"), reasons.alias("reasons"),
    )
    none = F.struct(
        F.lit(False).alias("matched"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("display"),
        F.lit(None).cast("string").alias("format"), F.lit(0).alias("score"), F.lit(0.0).alias("confidence"), F.expr("CAST(array() AS array<string>)").alias("reasons"),
    )
    return F.when(F.coalesce(matched, F.lit(False)), found).otherwise(none)


def book_part(c: Column) -> Column:
    """``struct<kind, number, title>``: prologue, epilogue, chapter, or none; group titles (volume, part, arc) are none."""
    t = compact(c)
    group = t.rlike(r"(?iu)^(?:volume|vol\.|part|parte|arc|arco|book|livro|libro|tome)\b")
    number = F.coalesce(F.regexp_extract(t, PREFIX, 2).try_cast("int"), F.regexp_extract(t, r"(?iu)^(?:cap[ií]tulo|chapter|chapitre)\s+(\d{1,4})$", 1).try_cast("int"), F.regexp_extract(t, NUMBERED, 1).try_cast("int"))
    title = F.coalesce(some(F.regexp_extract(t, PREFIX, 3)), some(F.regexp_extract(t, NUMBERED, 2)), some(F.regexp_extract(t, r"(?iu)^(?:pr[óo]log[ou]e?|prologue|ep[ií]logo|epilogue|épilogue)\s*[.:—–-]?\s*(.*)$", 1)))
    kind = (
        F.when(group, None).when(t.rlike(r"(?iu)^(?:pr[óo]logo|prologue)\b"), "prologue").when(t.rlike(r"(?iu)^(?:ep[ií]logo|epilogue|épilogue)\b"), "epilogue")
        .when(number.isNotNull(), "chapter")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "chapter", number).alias("number"), F.when(kind.isNotNull(), title).alias("title"))


def first_heading(lines: Column, most: int = 40) -> Column:
    """The first of the leading lines that is a heading."""
    return F.try_element_at(F.filter(F.slice(lines, 1, most), lambda x: parse_heading(x)["matched"]), F.lit(1))


def roman(c: Column) -> Column:
    """Value of a Roman numeral (letters only are checked, as printed headings demand no more)."""
    value = F.create_map(*[F.lit(x) for p in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in p])
    v = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda x: F.try_element_at(value, x))
    following = lambda i: F.coalesce(F.try_element_at(v, i + 2), F.lit(0))
    return F.when(c.rlike("^[ivxlcdmIVXLCDM]+$"), F.aggregate(F.transform(v, lambda x, i: F.when(x < following(i), -x).otherwise(x)), F.lit(0), lambda a, x: a + x))


def number_words(c: Column, most: int = 7) -> Column:
    """Sum of the number words that lead a text, joined by ``e`` (no grammar)."""
    value = F.create_map(*[F.lit(x) for p in NUMBER_WORDS.items() for x in p])
    words = F.slice(F.split(compact(fold(c)), " "), 1, most)
    state = F.aggregate(
        words,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, w: F.struct(
            F.when(a["on"] & F.try_element_at(value, w).isNotNull(), a["sum"] + F.try_element_at(value, w)).otherwise(a["sum"]).alias("sum"),
            F.when(a["on"] & F.try_element_at(value, w).isNotNull(), a["n"] + 1).otherwise(a["n"]).alias("n"),
            (a["on"] & ((w == "e") | F.try_element_at(value, w).isNotNull())).alias("on"),
        ),
    )
    return F.when(state["n"] > 0, state["sum"])


def printed_number(c: Column) -> Column:
    """Number of a printed heading: digits, a Roman numeral or number words after the word for chapter."""
    rest = F.regexp_extract(compact(c), r"(?iu)^(?:cap[ií]tulo|chapter|chapitre)\s+(.+)$", 1)
    first = F.regexp_extract(rest, r"^(\S+)", 1)
    return F.coalesce(F.regexp_extract(rest, r"^(\d+)", 1).try_cast("int"), roman(F.regexp_replace(first, r"[.:—–-]+$", "")), number_words(rest))


def display_title(c: Column) -> Column:
    """``struct<normalized, changed>``: prefix and number with one colon before the title."""
    t = compact(c)
    prefix, number, rest = (F.regexp_extract(t, r"(?iu)^(cap[ií]tulo|chapter|chapitre)\s+(\d{1,4})\s*[.:—–-]?\s*(.*)$", i) for i in (1, 2, 3))
    made = F.when(number == "", t).when(rest == "", F.concat(title_case(prefix), F.lit(" "), number)).otherwise(F.concat(title_case(prefix), F.lit(" "), number, F.lit(": "), rest))
    return F.struct(made.alias("normalized"), (made != t).alias("changed"))


def file_range(name: Column) -> Column:
    """``struct<first, last>`` of a name such as ``book 061-120.epub``."""
    p = r"(?<!\d)0*(\d{1,4})\s*(?:-|–|_|to|a|ate|até)\s*0*(\d{1,4})(?!\d)"
    return F.struct(F.regexp_extract(name, p, 1).try_cast("int").alias("first"), F.regexp_extract(name, p, 2).try_cast("int").alias("last"))


# What marks a title as generic, a file's name or told text; longest title and number of words of a sentence.
GENERIC_TITLES = r"^(?:bsj|converted ebook|untitled|sem título|sin título|começar|start)$"
FILE_TITLES = r"^(?:index_split_|split_|chapter_|chap_|page_|text/|xhtml/)|\.(?:xhtml|html)$"
TOLD = r"(?i)\b(?:murmur[oó]|dijo|pregunt[oó]|respond[ií]o|susurr[oó]|mir[oó])\b"
TITLE_CHARS, SENTENCE_WORDS, FRAGMENT_WORDS, BODY_WORDS = 90, 5, 8, 100


def _title(c: Column) -> Column:
    return without_markup(c)


def _words(t: Column, blank: str = " ") -> Column:
    return F.size(F.split(t, blank))


def is_generic_title(c: Column) -> Column:
    """Empty, ornaments only, a placeholder, or a bare chapter number."""
    t = F.lower(_title(c))
    return (t == "") | t.rlike(r"^\*{1,5}$") | t.rlike("^[-–—_•·]+$") | t.rlike(GENERIC_TITLES) | t.rlike(r"^cap[ií]tulo\s*\d*$")


def is_file_title(c: Column) -> Column:
    return F.lower(_title(c)).rlike(FILE_TITLES)


def is_chapter_title(c: Column) -> Column:
    """Short enough, no sentence, nothing that somebody says."""
    t = _title(c)
    sentence = t.rlike("[.!?…]") & (_words(t) > SENTENCE_WORDS)
    return (t != "") & ~is_generic_title(c) & ~is_file_title(c) & (F.length(t) <= TITLE_CHARS) & ~sentence & ~t.rlike(TOLD)


def title_quality(c: Column, score: Column | int = 0, words: Column | int = 0) -> Column:
    """``struct<quality, reason>``: valid, suspicious (an unnumbered title over a full text) or invalid; the first rule that fits.

    ``score`` is that of the heading parser, ``words`` the number of words of the document under the title.
    """
    t = _title(c)
    quoted = t.rlike("^[“\"'‘]")
    fragment = quoted | (t.rlike(r"[.!?]$") & (_words(t) >= 3)) | (_words(t) > FRAGMENT_WORDS)
    score, words = (x if isinstance(x, Column) else F.lit(x) for x in (score, words))
    rules = [
        (t == "", "invalid", "EMPTY_TITLE"), (is_generic_title(c), "invalid", "GENERIC_TITLE"), (is_file_title(c), "invalid", "FILENAME_TITLE"),
        (t.rlike(r"(?i)^bsj$|^\*+$"), "invalid", "MARKER_NOT_TITLE"), (t.rlike("(?i)converted ebook"), "invalid", "GENERIC_TITLE"), (fragment, "invalid", "TEXT_FRAGMENT_TITLE"),
        (is_chapter_title(c), "valid", "CHAPTER_PATTERN"), (F.coalesce((score >= 30) & (words > BODY_WORDS), F.lit(False)), "suspicious", "UNNUMBERED_POSSIBLE_TITLE"),
    ]
    out = F.struct(F.lit("invalid").alias("quality"), F.lit("UNKNOWN_PATTERN").alias("reason"))
    for condition, quality, reason in reversed(rules):
        out = F.when(condition, F.struct(F.lit(quality).alias("quality"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def title_score(c: Column) -> Column:
    """100 for a chapter title, 20 for another short one, 0 for what is none."""
    t = _title(c)
    none = is_generic_title(c) | is_file_title(c) | t.rlike(r"(?i)^bsj$|^\*+$|converted ebook")
    return F.when(none, 0).when(is_chapter_title(c), 100).when((F.length(t) <= 60) & (_words(t) <= 6) & ~t.rlike("[.!?…]$"), 20).otherwise(0)


def best_title(*candidates: Column) -> Column:
    """The candidate with the best score, earlier ones first."""
    ranked = F.array(*(F.struct(title_score(c).alias("score"), F.lit(-i).alias("order"), c.alias("title")) for i, c in enumerate(candidates)))
    return F.array_max(ranked)["title"]


def is_footnote_entry(c: Column) -> Column:
    """A numbered bibliographic note rather than a heading."""
    return compact(c).rlike(r"(?iu)^\d{1,4}[.)]\s+.*(?:\bpp?\.\s*\d|\bed\.|\bvol\.|\bISBN\b|https?://|\(\d{4}\))")


def is_sibling_title(c: Column) -> Column:
    """A line that may continue a bare chapter heading."""
    t = compact(c)
    return F.length(t).between(2, 140) & ~parse_heading(c)["matched"] & ~is_footnote_entry(c) & ~t.rlike(r"[.;,]$")
