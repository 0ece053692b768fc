"""Column functions on literal rows."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import headings, model_text, similarity, text


def values(spark, rows, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_cleaning(spark):
    t = F.col("t")
    assert values(spark, [" a  b\t\nc ", None, ""], text.compact(t)) == ["a b c", "", ""]
    assert values(spark, ["Ação — É"], text.folded(t)) == ["acao — e"]
    assert values(spark, ["Ação"], text.folded(t)) == ["acao"]
    assert values(spark, ["O «livro», co-autor!"], text.comparable(t)) == ["o livro co-autor"]
    assert values(spark, ["<b>A&amp;B</b>​"], text.without_markup(t)) == ["A&B"]
    assert values(spark, ["a\u0001b"], text.normalized(t)) == ["ab"]


def test_tokens_names_numbers(spark):
    t = F.col("t")
    assert values(spark, ["d'água co-autor 3"], text.tokens(t)) == [["d'água", "co-autor", "3"]]
    assert values(spark, ["1.234 e 7 e 12,5 e 12,5"], text.numbers(t)) == [["1.234", "7", "12,5"]]
    assert values(spark, ["1.234 e 7"], text.telling_numbers(t)) == [["1234"]]
    assert values(spark, ["The Guard met Ana Maria"], text.proper_names(t)) == [["Guard", "Ana", "Maria"]]
    assert values(spark, ["One. Two! Three… four"], text.sentences(t)) == [["One.", "Two!", "Three…", "four"]]


def test_terms_and_keys(spark):
    t = F.col("t")
    assert values(spark, ["A ação; reação ação"], text.count_term(t, "ação")) == [2]
    assert values(spark, ["x" * 400], F.length(text.preview(t, 300))) == [300]
    assert values(spark, ["pt_br", "PT-br", "zh-hant-tw", None], text.language_tag(t)) == ["pt-BR", "pt-BR", "zh-Hant-TW", None]
    assert values(spark, ["ch10", "ch9"], text.natural_key(t)) == ["ch000000000010", "ch000000000009"]
    assert values(spark, ["o senhor dos anéis"], text.title_case(t)) == ["O Senhor dos Anéis"]
    assert values(spark, ["Ação & Reação!"], text.slug(t)) == ["acao-reacao"]
    h = 5381
    for c in "key-1":
        h = (h * 33 + ord(c)) % 2**32
    assert values(spark, ["key-1"], text.djb2(t)) == [h]


@pytest.mark.parametrize(
    ("line", "number", "title", "kind"),
    [
        ("Capítulo 17 - O portão", 17, "O portão", "explicit-prefix"), ("CAPÍTULO 260 — A torre", 260, "A torre", "explicit-prefix"), ("Chapter 3: The gate", 3, "The gate", "explicit-prefix"),
        ("Cap. 17 O rio", 17, "O rio", "explicit-prefix"), ("17. Título", 17, "Título", "numbered-punctuation"), ("17) Título", 17, "Título", "numbered-punctuation"),
        ("17 anos depois", None, None, None), ("2024 foi um ano difícil", None, None, None), ("17", None, None, None), ("Capítulo", None, None, None), ("Capítulo dez", None, None, None),
    ],
)
def test_heading(spark, line, number, title, kind):
    h = values(spark, [line], headings.parse_heading(F.col("t")))[0]
    assert (h.number, h.title, h.format, h.matched) == (number, title, kind, kind is not None)


def test_numbers_in_words(spark):
    assert values(spark, ["Capítulo XIV", "Capítulo vinte e três — A porta", "Chapter 9: Z"], headings.printed_number(F.col("t"))) == [14, 23, 9]
    assert values(spark, ["book 061-120.epub"], headings.file_range(F.col("t"))) == [(61, 120)]
    titles = ["", "text.xhtml", "Capítulo 3", "The gate", "***", "<b>Untitled</b>", "“Who is there?”", "He went to the river.", "A title of more than eight words is a fragment", "x" * 95, "a. b c d e f g"]
    q = [tuple(r) for r in values(spark, titles, headings.title_quality(F.col("t")))]
    assert [x[1] for x in q] == ["EMPTY_TITLE", "FILENAME_TITLE", "GENERIC_TITLE", "CHAPTER_PATTERN", "GENERIC_TITLE", "GENERIC_TITLE", "TEXT_FRAGMENT_TITLE", "TEXT_FRAGMENT_TITLE", "TEXT_FRAGMENT_TITLE", "UNKNOWN_PATTERN", "UNKNOWN_PATTERN"]
    assert [x[0] for x in q] == ["valid" if r == "CHAPTER_PATTERN" else "invalid" for _, r in q]
    assert values(spark, ["x" * 95], headings.title_quality(F.col("t"), 40, 200)["quality"]) == ["suspicious"]


@settings(max_examples=25, deadline=None)
@given(a=st.text("abcd éß", max_size=12), b=st.text("abcd éß", max_size=12))
def test_dice_against_plain(spark, a, b):
    grams = lambda s: {x[i : i + 2] for x in ["".join(s.lower().split())] for i in range(len(x) - 1)}
    n = len(grams(a)) + len(grams(b))
    want = 2 * len(grams(a) & grams(b)) / n if n else 0.0
    got = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.dice(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(want)


def test_repetition(spark):
    run = spark.createDataFrame([("the old man went home the old man went home again",), ("nothing here",), (None,)], "t string").select(text.long_tokens(F.col("t")).alias("w")).select(similarity.repeated_run(F.col("w"))).collect()
    assert [r[0] for r in run] == ["the old man went home", None, None]


def test_model_text(spark):
    t = F.col("t")
    assert values(spark, ["<think>x</think>Sure, here it is:\nTexto."], model_text.clean_output(t)) == ["Texto."]
    assert values(spark, ['noise {"a": 1} tail', "none"], model_text.json_object(t)) == ['{"a": 1}', None]
    rows = spark.createDataFrame([("Ana has 12 apples and Rui has a long story to tell you", "Ana tem 12 maçãs e Rui tem uma longa história", 0.9), ("Ana has 12 apples", "Ana tem 13 maçãs", 0.9), ("a", "b", 0.2)], "s string, t string, c double")
    got = [r[0].reason for r in rows.select(model_text.suggestion_verdict(F.col("s"), F.col("t"), F.col("c"))).collect()]
    assert got == ["rewritten", "numbers_changed", "low_confidence"]


def test_fold_agrees_with_decomposition(spark):
    s = "ÁÀÂÃÄÇÉÊÍÓÔÕÚÜÑ"
    plain = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    assert values(spark, [s], text.fold(F.col("t"))) == [plain]
