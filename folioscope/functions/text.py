"""Column functions over text: cleaning, keys, tokens, names, numbers, sentences, terms.

One place fixes the regex dialect: classes are Unicode classes, ``\\s`` is widened to all blanks (``BLANKS``), case is
ignored with ``(?iu)``, and a word edge is "no letter or digit beside it", the same for every script.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
CONTROLS = r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]"
#: Latin letters with accents and their plain forms.
ACCENTED = "áàâãäåāăąçćčďéèêëēėęěíìîïīñńňóòôõöōőřśšťúùûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiinnnooooooorsstuuuuuuuyyzzz"
assert len(ACCENTED) == len(PLAIN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: an expression named inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def compact(c: Column) -> Column:
    """Blanks collapsed and trimmed, case kept."""
    return F.trim(F.regexp_replace(text_or_empty(c), BLANKS + "+", " "))


def normalized(c: Column) -> Column:
    """Control characters removed, then blanks collapsed."""
    return compact(F.regexp_replace(text_or_empty(c), CONTROLS, ""))


def normalized_late(c: Column) -> Column:
    """Blanks collapsed first, control characters removed after: a control character between blanks leaves both."""
    return F.regexp_replace(compact(c), CONTROLS, "")


def fold(c: Column) -> Column:
    """Lower case without accents, for composed and decomposed characters alike."""
    return F.translate(F.regexp_replace(F.lower(text_or_empty(c)), r"\p{M}+", ""), ACCENTED, PLAIN)


def folded(c: Column) -> Column:
    return compact(fold(c))


def comparable(c: Column) -> Column:
    """Folded, punctuation as blanks, hyphens kept."""
    return compact(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\s-]", " "))


def key_text(c: Column) -> Column:
    """Folded, only a-z and 0-9."""
    return compact(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))


def heading_key(c: Column) -> Column:
    """Folded, everything but word characters as blanks."""
    return compact(F.regexp_replace(fold(c), r"[^\w\s]", " "))


def without_markup(c: Column) -> Column:
    """Tags gone, common entities and zero-width characters resolved."""
    t = F.regexp_replace(text_or_empty(c), r"<[^>]*>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(to))
    return compact(F.regexp_replace(t, r"[\u200b-\u200d\u2060\ufeff]", ""))


def clean_for_comparison(c: Column) -> Column:
    """Lower case, punctuation removed, accents kept."""
    return compact(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}\s]", ""))


def clean_word(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def tokens(c: Column) -> Column:
    """Words with inner apostrophes and hyphens."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"), 0)


def long_tokens(c: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), 0)


def content_tokens(c: Column, stopwords: list[str], least: int = 4) -> Column:
    return F.array_distinct(F.array_except(long_tokens(c, least), F.array(*map(F.lit, stopwords)) if stopwords else F.expr("CAST(array() AS array<string>)")))


def letter_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"\p{L}+"), 0))


def ascii_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9]+"), 0))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(r"\d+(?:[.,]\d+)?"), 0))


def telling_numbers(c: Column) -> Column:
    """Numbers without separators of thousands; single digits do not tell anything."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"\d[\d.,]*"), 0)
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.regexp_replace(n, r"[.,]", "")), lambda n: F.length(n) > 1))


def has_number(c: Column, number: Column) -> Column:
    """The number stands alone, or its metres are written as centimetres and the other way round."""
    alone = lambda n: F.expr("true") & F.array_contains(F.regexp_extract_all(text_or_empty(c), F.lit(r"(?<![\d.,])\d+(?:[.,]\d+)?(?![\d])"), 0), n)
    value = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    hundredfold = F.regexp_replace(F.round(value * 100).cast("bigint").cast("string"), r"\.0$", "")
    return alone(number) | F.coalesce(alone(hundredfold) & c.rlike(r"(?iu)\d\s*cm\b"), F.lit(False))


#: English and Portuguese words that start sentences and are no names.
STARTERS = "The A An And But When Then This That With He She His Her They It I O Os As Um Uma Ele Ela Eles Elas Isso Então Quando Como Para Com Sem Mas Seção".split()
#: Spanish and French ones, for the other languages of the tables. Pass ``STARTERS`` as ``blocked`` to go without them.
NO_NAMES = [*STARTERS, *"El La Los Las Un Una Le Les Des Il Elle".split()]


def proper_names(c: Column, blocked: list[str] | None = None) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{N}'-]{2,}(?![\p{L}\p{N}])"), 0))
    return F.array_except(found, F.array(*map(F.lit, NO_NAMES if blocked is None else blocked)))


def compound_names(c: Column, fixed: list[str] | None = None, generic: list[str] | None = None) -> Column:
    """Runs of capitalised words and given terms, without generic words, longest first."""
    runs = F.regexp_extract_all(text_or_empty(c), F.lit(r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}'-]+(?:\s+(?:of|the|de|da|do|dos|das|del|du|des|la)?\s*\p{Lu}[\p{L}'-]+)*"), 0)
    given = F.filter(F.array(*map(F.lit, fixed)), lambda t: F.contains(text_or_empty(c), t)) if fixed else F.expr("CAST(array() AS array<string>)")
    kept = F.filter(F.array_distinct(F.concat(runs, given)), lambda n: F.length(n) > 2)
    if generic or NO_NAMES:
        kept = F.array_except(kept, F.array(*map(F.lit, [*NO_NAMES, *(generic or [])])))
    return F.transform(F.array_sort(F.transform(kept, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda s: s["n"])


def punctuation_profile(c: Column) -> Column:
    t = text_or_empty(c)
    return F.struct(t.rlike("[?？]").alias("question"), t.rlike("[!！]").alias("exclamation"), t.rlike("[\"“”‘’«»「」]").alias("quote"))


def sentences(c: Column) -> Column:
    return F.filter(F.split(compact(c), r"(?<=[.!?…])\s+"), lambda s: s != "")


def preview(c: Column, limit: int = 300) -> Column:
    """At most ``limit`` characters, three dots at the end of what was cut."""
    t = compact(c)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def excerpt(c: Column, limit: int = 520) -> Column:
    t = compact(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def sentence_containing(c: Column, needle: Column, limit: int = 320) -> Column:
    """The first sentence that has the needle (folded), else the text, as a preview."""
    hit = F.try_element_at(F.filter(sentences(c), lambda s: F.contains(comparable(s), comparable(needle))), F.lit(1))
    return preview(F.coalesce(hit, c), limit)


def term_regex(term: str) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])\Q{term}\E(?![\p{{L}}\p{{N}}])"


def _term_pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))


def has_term(c: Column, term: str | Column) -> Column:
    return c.rlike(term_regex(term)) if isinstance(term, str) else F.regexp_like(c, _term_pattern(term))


def count_term(c: Column, term: str | Column) -> Column:
    return F.regexp_count(c, F.lit(term_regex(term)) if isinstance(term, str) else _term_pattern(term))


def words_around(c: Column, term: Column, reach: int = 6) -> Column:
    """Up to ``reach`` words on both sides of the first match of a one-word term."""
    words = F.split(compact(c), " ")
    at = F.array_position(F.transform(words, lambda w: clean_word(w)), F.lower(term)).cast("int")
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(words, start, at - start + 1 + reach), " "))


def kwic(width: int = 90, most: int = 5):
    """Arrow UDF ``(text, term) -> array<struct<match, context, at>>``: offsets are what built-ins cannot give."""

    @F.pandas_udf("array<struct<match: string, context: string, at: int>>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[str, re.Pattern] = {}
        for texts, terms in parts:
            out = []
            for text, term in zip(texts, terms):
                if not text or not term:
                    out.append([])
                    continue
                if len(made) > 10_000:
                    made.clear()
                pattern = made.get(term) or made.setdefault(term, re.compile(rf"(?<!\w){re.escape(term)}(?!\w)", re.I))
                found = []
                for m in pattern.finditer(text):
                    found.append({"match": m[0], "context": " ".join(text[max(0, m.start() - width) : m.end() + width].split()), "at": m.start()})
                    if len(found) == most:
                        break
                out.append(found)
            yield pd.Series(out)

    return run


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(compact(c), " "), 1, n), " ")


def last_words(c: Column, n: int) -> Column:
    words = F.split(compact(c), " ")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ")


def count_paragraphs(c: Column) -> Column:
    return F.size(F.filter(F.split(text_or_empty(c), r"\n\s*\n"), lambda p: F.trim(p) != ""))


def count_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(text_or_empty(c), r"\r?\n"), lambda p: F.trim(p) != ""))


def codes(c: Column) -> Column:
    """Tokens such as ``A-12`` or ``XK47``."""
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(r"(?<![\p{L}\p{N}])[A-Z]{1,5}-?\d{1,6}(?![\p{L}\p{N}])"), 0))


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_file_name(c: Column, limit: int = 120) -> Column:
    return F.substring(compact(F.regexp_replace(text_or_empty(c), r'[<>:"/\\|?*\u0000-\u001f]', " ")), 1, limit)


#: Words that stay small inside a title.
SMALL = "de da do das dos e em a o as os na no nas nos para por com um uma of the and in on to for a an del la las los el y du des le les et".split()


def title_case(c: Column, small: list[str] | None = None) -> Column:
    low = F.array(*map(F.lit, SMALL if small is None else small))
    words = F.split(F.lower(compact(c)), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(low, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))), " ")


def language_tag(c: Column) -> Column:
    """``pt_br`` and ``PT-br`` become ``pt-BR``."""
    parts = F.split(F.trim(F.replace(c, F.lit("_"), F.lit("-"))), "-")
    rest = F.transform(F.slice(parts, 2, 10), lambda p: F.when(F.length(p) == 2, F.upper(p)).when(F.length(p) == 4, F.initcap(p)).otherwise(F.lower(p)))
    return F.when(F.trim(c) != "", F.array_join(F.concat(F.array(F.lower(parts[0])), rest), "-"))


def language_base(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1), F.lit(""))


def natural_key(c: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), width, "0")).otherwise(r)), "")


def djb2(c: Column) -> Column:
    """32-bit rolling hash of the characters."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(5381).cast("bigint"), lambda a, x: (a * 33 + x) % F.lit(4294967296))


def display_id(c: Column) -> Column:
    """``id`` and five digits: for people, never a key."""
    return F.format_string("id%05d", djb2(c) % 100_000)


def short_hash(c: Column) -> Column:
    return F.substring(F.md5(normalized(c)), 1, 8)


def cache_key(source: Column, target: Column, chars: int = 500) -> Column:
    return F.md5(F.concat(F.substring(text_or_empty(source), 1, chars), F.lit("|"), F.substring(text_or_empty(target), 1, chars)))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole)).otherwise(F.lit(0.0))
