"""The operators of the nine problems: against plain versions, on edge cases, on empty tables."""

import base64
import html as htmllib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import alignment, graph, langid, nameforms, names, packing, responses, sitelines, splitting, tokenizer, truncation

LONG = "word " * 40_000


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# 7 -----------------------------------------------------------------------------------------------------------------------

TEXTS = ["", None, "Hello world", "don't WE'LL 12345   \n\n x", "ação — ñandú 😀", "<|endoftext|>", " " * 300 + "a", "\u0000\u0001", "é" * 3000, "日本語 テキスト"]


def test_ids_equal_rank_merging(spark):
    import tiktoken

    path = f"{tokenizer.VOCABULARIES}/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokenizer.encode_texts(df).collect()}
    assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in tokenizer.count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in tokenizer.decode_ids(tokenizer.encode_texts(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenizer.encode_texts(df.limit(0)).count() == 0


def test_memo_limit_changes_nothing():
    path = f"{tokenizer.VOCABULARIES}/byte_bpe_50k.tiktoken"
    small, large = tokenizer.ByteBPE(path, memo=5), tokenizer.ByteBPE(path)
    texts = ["one two three four five six seven", "eight nine ten one two", "three"]
    for t in texts * 2:
        assert small.encode([t]) == large.encode([t])


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_vocabularies(name):
    t = tokenizer.tokenizer(name)
    assert t.encode(["", None]) == [[], []] and t.count(["a text", ""])[0] == len(t.encode(["a text"])[0]) > 0


# 6 -----------------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text("ab. \n漢。é", min_size=0, max_size=400), st.integers(20, 80), st.integers(0, 19))
def test_pieces_cover_the_text(text, limit, overlap):
    spans = splitting.cut_points(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans if text)
    assert all(c == b - overlap for (_, b), (c, _) in zip(spans, spans[1:]))


def test_cuts_at_sentences_then_words_then_hard():
    assert splitting.cut_points("First one. Second one is long.", 20, 3)[0] == (0, 11)
    assert splitting.cut_points("one two three four five six seven", 12, 2)[0] == (0, 8)
    assert splitting.cut_points("x" * 30, 12, 2)[0] == (0, 12)


def test_sentence_ends_before_many_blanks():
    """However many blanks and closing marks stand behind a full stop, it is a boundary."""
    head = "word " * 300 + "end.”)" + " " * 400
    cut = splitting.cut_points(head + "more words " * 300, 3000, 0)[0][1]
    assert cut == len(head)


def test_split_edge_cases(spark):
    df = spark.createDataFrame([(1, [None, "", "short", LONG]), (1, [None, "", "short", LONG]), (2, None), (3, [])], "chapter_id bigint, paragraphs array<string>").withColumn("_text", F.lit(1))
    pieces = splitting.split_oversized(df).orderBy("piece_no").collect()
    assert {(p.chapter_id, p.paragraph_index) for p in pieces} == {(1, 3)} and max(len(p.piece) for p in pieces) <= 3000
    assert "".join(p.piece[200 if p.piece_no else 0 :] for p in pieces) == LONG
    assert rows(splitting.oversized(df)) == [(1, 3)]
    assert splitting.oversized(df.limit(0)).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_packing_never_exceeds(sizes):
    window = packing.pack(np.array(sizes), 50)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= 50 and (window >= 0).all()
    assert (sums > 0).sum() <= 2 * -(-sum(sizes) // 50)


def test_containers(spark):
    sizes = [(i, (i * 37) % 300 + 1) for i in range(400)] + [(1000, 5000), (1001, 2048), (1002, 0), (1003, None), (1003, None), (1, 5)]
    out = packing.fill_containers(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").withColumn("_bucket", F.lit(0)))
    fill = packing.container_fill(out).collect()
    assert max(f.used for f in fill) <= 2048
    assert sum(f.used for f in fill) == sum(n or 0 for _, n in sizes)
    assert len(fill) <= 1.03 * sum(n or 0 for _, n in sizes) / 2048 + 2
    big = sorted((r.piece_no, r.token_start, r.n_tokens) for r in out.where("doc_id = 1000").collect())
    assert big == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert out.where("container_id IS NULL").count() == 3
    assert packing.fill_containers(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    urls = ["https://www.S.example:8080/a", "s.example/x?y#z", "//m.s.example", "http://user@read.S.EXAMPLE."]
    data = [(i, urls[i % 4], [f"Story line number {'abcdefghij'[i % 10] * (i + 3)}", "Read at S, page %d!" % i, None, "", "***"]) for i in range(12)]
    data += [(12, None, ["Read at S, page 1!"]), (13, "", ["x"]), (14, "s.example", None), (15, "t.example", ["READ AT S page"]), (0, *data[0][1:])]
    df = spark.createDataFrame(data, "chapter_id bigint, url string, paragraphs array<string>").withColumn("site", F.lit("clash")).withColumn("_id", F.lit(1))
    found, templates = sitelines.repeated_lines(df)
    assert rows(found.select("chapter_id", "paragraph_index").distinct()) == sorted(((i, 1) for i in range(12)), key=repr)
    assert templates.where("covered >= 12").count() == 1
    clean = sitelines.without_repeated(df.dropDuplicates(["chapter_id"]), found)
    kept = {r.chapter_id: (len(r.paragraphs or []), r.removed) for r in clean.collect()}
    assert kept[3] == (4, 1) and kept[15] == (1, 0) and kept[14] == (0, 0)
    assert sitelines.repeated_lines(df.limit(0))[0].count() == 0


def test_leaf_is_the_same_with_its_index():
    """The index of a leaf finds the template that a scan of all of them finds first."""
    import random

    r = random.Random(5)
    lines = ["aaaaabbbbb" + "".join(r.choice(["ccccc", "ddddd", "eeeee"]) for _ in range(r.randint(0, 5))) for _ in range(400)]
    tree, plain = sitelines.Leaf(), []

    def scan(parts):
        for i, t in enumerate(plain):
            if len(t) == len(parts) and sum(a == b for a, b in zip(t, parts)) >= sitelines.ALIKE * len(parts):
                plain[i] = [a if a == b else "*" for a, b in zip(t, parts)]
                return i
        plain.append(parts)
        return len(plain) - 1

    for x in lines:
        assert tree.grow(sitelines.segments(x)) == scan(sitelines.segments(x))
    assert tree.templates == plain


def test_sites(spark):
    got = spark.createDataFrame([("https://www.A.example:80/x",), ("b.example:8080/q",), ("ftp://u:p@c.d.example?x",), (None,), ("",), ("localhost",)], "u string").select(sitelines.site_of(F.col("u"))).collect()
    assert [r[0] for r in got] == ["a.example", "b.example", "d.example", None, None, "localhost"]


# 9 -----------------------------------------------------------------------------------------------------------------------


def test_lengths(spark):
    t = 'a & <b> "q" \'s\' é😀\nx\r\ny\\'
    got = spark.createDataFrame([(t,)], "t string").select(*[c.alias(k) for k, c in truncation.stored_lengths(F.col("t")).items()]).first().asDict()
    assert got["code points"] == len(t) and got["UTF-8"] == len(t.encode()) and got["UTF-16"] == len(t.encode("utf-16-le")) // 2
    assert got["entities"] == len(htmllib.escape(t)) and got["CRLF"] == len(t.replace("\r\n", "\n").replace("\n", "\r\n"))


def test_truncation(spark):
    base = ["The gate fell in the river.", "Nobody saw the old king again.", "She said: “The road is closed.”", "— A água está subindo…", "— A água está subindo…\nO rio subiu."]
    data = [(i, f"{base[i % 5]} Part {i}.\n{base[(i + 1) % 5]}", "s") for i in range(60)]
    data += [(100 + i, f"A story number {i}.\nEnd of chapter {i}", "s") for i in range(6)]
    data += [(200, "The gate fell in the ri", "s"), (201, "The guards searched the", "s"), (202, "She looked at the ri…", "s"), (203, "A story.\nThe <em", "s"), (204, "He went to (read more)", None), (205, "He went, ", None)]
    data += [(300, None, "s"), (301, "", "s"), (302, "***", "s"), (303, LONG + "end.", "s")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").withColumn("mark", F.lit("clash"))
    judged, _ = truncation.truncated(df)
    assert rows(judged.where("cut").select("doc_id")) == [(i,) for i in range(200, 206)]
    share = {r.source: r.cut for r in truncation.shares(judged).collect()}
    assert share == {"s": 4, None: 2}
    assert truncation.truncated(df.limit(0))[0].count() == 0


def test_ends_of_any_length(spark):
    """Blanks behind the end, a long mark, a long last line: nothing is cut off before it is read."""
    data = [(1, "The gate fell." + " \n" * 2000), (2, "The gate fe" + " " * 2000), (3, "The gate fell in the ri<span class='" + "x" * 900), (4, "the " * 900 + "end."), (5, "the " * 900 + "en")]
    data += [(10 + i, f"A story of gate {i}.") for i in range(40)]
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in truncation.truncated(df)[0].where("cut").collect()} == {2, 3, 5}


def test_limits_decide_for_spoken_ends(spark):
    """A spoken line that ends like others do is whole, but not where its source cuts."""
    talk = "— A água está subindo…"
    pad = lambda n, end: ("The old man walked to the river. " * 40)[: n - len(end) - 1] + "\n" + end
    data = [(i, "s", f"{i:03d} " + ("nobody knew who had opened the door of the house " * 9)[:396]) for i in range(12)]
    data += [(100 + i, "s", f"{i} The gate fell.\n{talk}" + " So it was." * (i % 7)) for i in range(30)]
    data += [(200, "s", pad(401, talk)), (201, "t", pad(401, talk)), (202, "s", pad(300, talk))]
    df = spark.createDataFrame(data, "doc_id bigint, source string, text string")
    judged, limits = truncation.truncated(df)
    assert {r.doc_id for r in judged.where("cut AND doc_id >= 100").collect()} == {200}


def test_limits(spark):
    data = [(i, "x" * 99 + "y", "s") for i in range(8)] + [(100 + i, "z" * (50 + i) + ".", "s") for i in range(40)]
    df = spark.createDataFrame([(i, t[: 100 - len(str(i))] + str(i) if len(t) == 100 else t, s) for i, t, s in data], "doc_id bigint, text string, source string")
    _, limits = truncation.truncated(df)
    assert (100, "code points") in {(r["size"], r["way"]) for r in limits.collect()}


# 5 -----------------------------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": ["the old man walked to the river with his dog", "nobody knew who had opened the door that night", "she was holding the lantern when the bells stopped", "they shared bread and salt before the storm"],
    "pt": ["o velho caminhou até o rio com o seu cão", "ninguém sabia quem tinha aberto a porta naquela noite", "ela segurava a lanterna quando os sinos pararam", "eles dividiram pão e sal antes da tempestade"],
    "es": ["el viejo caminó hasta el río con su perro", "nadie sabía quién había abierto la puerta aquella noche", "ella sostenía el farol cuando callaron las campanas", "compartieron pan y sal antes de la tormenta"],
}


def language_tables(spark):
    docs, reports, n = [], [], 0
    for lang, ss in SENTENCES.items():
        for i in range(40):
            docs.append((n, "\n".join(ss[(i + k) % 4].capitalize() + "." for k in range(4)), lang))
            reports.append((n, n, lang, lang, "2024-01-01"))
            n += 1
    docs += [(500, "The old man walked to the river.\nEla segurava a lanterna quando os sinos pararam.\nNobody knew who had opened the door.", "en"), (501, None, "en"), (502, "", "en"), (503, "!!!", "en"), (504, "Nadie sabía quién había abierto la puerta.", "en")]
    reports += [(500, 500, "en_GB", "en", "2024-01-01"), (501, 501, None, None, "2024-01-01"), (504, 504, "es", "es", "2024-01-01"), (505, 504, "English", "es", "2024-02-01"), (505, 504, "English", "es", "2024-02-01"), (506, 0, "x", "en", "2024-03-01")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(reports, "report_id bigint, doc_id bigint, metadata_language string, detected_language string, generated_at string")


def test_languages(spark):
    docs, reports = language_tables(spark)
    got = rows(langid.wrong_labels(docs, reports).select("doc_id", "line_no", "lang"))
    assert got == sorted([(0, 0, "en"), (500, 2, "pt"), (504, 0, "es")], key=repr)
    assert langid.wrong_labels(docs.limit(0), reports.limit(0)).count() == 0


def test_language_model_on_held_out_lines():
    texts = [s.capitalize() + "." for ss in SENTENCES.values() for s in ss[:3]] * 5
    labels = [x for x, ss in SENTENCES.items() for _ in ss[:3]] * 5
    m = langid.Model.fit(texts, labels)
    for lang, ss in SENTENCES.items():
        assert next(m.judge([ss[3]]))[0][1] == lang


def test_language_codes(spark):
    got = spark.createDataFrame([("pt_BR",), ("PT-br",), ("Português",), ("eng",), ("??",), (None,), ("fre",), (" EN ",)], "x string").select(langid.language_code(F.col("x"))).collect()
    assert [r[0] for r in got] == ["pt", "pt", "pt", "en", None, None, "fr", "en"]


# 4 -----------------------------------------------------------------------------------------------------------------------


def test_responses(spark):
    para = {"en": [s.capitalize() + "." for s in SENTENCES["en"]], "pt": [s.capitalize() + "." for s in SENTENCES["pt"]]}
    chapters = spark.createDataFrame([(1, para["en"]), (1, para["en"]), (2, para["pt"])], "chapter_id bigint, paragraphs array<string>")
    sections = spark.createDataFrame([(1, para["en"])], "section_id bigint, paragraphs array<string>")
    ask = "Translate the passage into Brazilian Portuguese."
    good = [(i, "chapter", 1, i % 4, "translate", ask, "pt", f"{para['pt'][i % 4]} Depois de {i} dias, o rio se calou.") for i in range(40)] + [(40 + i, "chapter", 2, i % 4, "translate", "Translate into English, keep the names.", "en", f"{para['en'][i % 4]} After {i} days the river was silent.") for i in range(40)]
    bad = [
        (100, "chapter", 1, 0, "translate", ask, "pt", None), (101, "chapter", 1, 0, "translate", ask, "pt", "Answer: "), (102, "chapter", 1, 0, "translate", ask, "pt", "<p></p>"),
        (103, "chapter", 1, 0, "translate", ask, "pt", "I'm sorry, but I cannot help with this request."), (104, "chapter", 1, 0, "translate", ask, "pt", "Sure! " + para["en"][0].upper()),
        (105, "chapter", 1, 1, "translate", ask, "pt", f"{ask}\n{para['en'][1]}"), (106, "chapter", 1, 0, "translate", ask, "pt", para["pt"][0][:20]), (107, "chapter", 1, 2, "translate", ask, None, para["en"][3] + " " + para["en"][1]),
        (108, "section", 1, 2, "question", "Who had opened the door?", None, "Who had opened the door?"),
    ]
    fine = [(200, "chapter", 1, 0, "translate", ask, "pt", '```\n"' + para["pt"][0] + '"\n```'), (201, "chapter", 1, 0, "translate", ask, "pt", "— Sinto muito, mas não posso ajudar você com isso — disse o velho."), (202, "chapter", 9, 0, "question", "Who was it?", None, "Ana Maria."), (203, "chapter", 1, 99, "question", None, None, "Rui")]
    schema = "chunk_id bigint, origin string, origin_id bigint, paragraph_index int, task string, instruction string, target_lang string, output_text string"
    chunks = spark.createDataFrame(good + bad + fine + bad[:2], schema).withColumn("model_name", F.lit(None).cast("string")).withColumn("core", F.lit("clash"))
    got = dict(rows(responses.defects(chunks, chapters, sections)))
    want = {100: "empty", 101: "empty", 102: "empty", 103: "refusal", 104: "copy", 105: "copy", 106: "truncated", 107: "wrong_language", 108: "copy"}
    assert got == want, (set(want.items()) ^ set(got.items()))
    assert responses.defects(chunks.limit(0), chapters.limit(0), sections.limit(0)).count() == 0


def test_shortened_neighbours_across_partitions(spark):
    texts = [f"The captain counted the barrels of ship {i:03d} before the storm" for i in range(200)]
    cores = texts + [t[:40] for t in texts[:1]] + ["The captain counted the barr"]
    # An ellipsis sorts behind all letters; a neighbour that goes on with a blank hides none behind it.
    cores += ["The captain counted the bar…", "The captain counted the barrels of ship 1...", "The captain count", "The captain count Borel arrived"]
    got = rows(responses.shortened(spark.createDataFrame([(t,) for t in sorted(set(cores))], "core string")).distinct())
    stem = lambda c: c.rstrip("…. ") if c.endswith(("…", "...")) else c
    want = {c for c in cores if any(responses.goes_on(stem(c), stem(d)) for d in cores if d != c)}
    assert {g[0] for g in got} == want and {"The captain counted the bar…", "The captain count"} <= want


def test_limits_decide_for_names_and_spoken_ellipses(spark):
    """A name as an answer, or a spoken line with an ellipsis, is cut where many unfinished responses of its model have its length."""
    para = ["The old man walked to the river with his dog, and nobody knew why."]
    chapters = spark.createDataFrame([(1, para)], "chapter_id bigint, paragraphs array<string>")
    text = lambda i, n: f"In year {i:04d} the captain of the guard counted all the barrels of the ship again and again"[:n]
    data = [(i, "m", text(i, 40)) for i in range(30)] + [(100 + i, "m", text(i, 50 + i % 20) + ".") for i in range(40)]
    spoken = "— In the dark hall they waited for the king"
    data += [(200, "m", spoken[:40] + "…"), (201, "other", spoken[:40] + "…"), (202, "m", "— The king was waiting for the gr" + "…"), (203, "m", "Mara Orlanth Vel")]
    chunks = spark.createDataFrame(data, "chunk_id bigint, model_name string, output_text string").selectExpr("*", "'chapter' AS origin", "1L AS origin_id", "0 AS paragraph_index", "'question' AS task", "'Who was it in the hall?' AS instruction", "CAST(NULL AS string) AS target_lang")
    got = dict(rows(responses.defects(chunks, chapters, chapters.withColumnRenamed("chapter_id", "section_id"))))
    assert got == {i: "truncated" for i in [*range(30), 200]}


# 2 -----------------------------------------------------------------------------------------------------------------------


def test_segment_join_finds_all_near_keys(spark):
    import random

    r = random.Random(4)
    keys = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 12))) for _ in range(150)})
    made = keys[:20] + [k[:i] + r.choice("abcd") + k[i + 1 :] for k in keys[:40] for i in (1, len(k) - 1)] + [k[:3] + k[4:] for k in keys[:30]]
    df = spark.createDataFrame([(1, "full", m) for m in sorted(set(made))], "book_id bigint, space string, source string")
    targets = spark.createDataFrame([(1, "full", k) for k in keys], "book_id bigint, space string, target string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for k in (0, 1, 2):
        got = {(x.source, x.target, x.edits) for x in names.near_keys(df.withColumn("k", F.lit(k)), targets).collect()}
        want = {(m, t, edits(m, t)) for m in set(made) for t in keys if edits(m, t) <= k}
        assert got == want


def test_entities(spark):
    alias = lambda *x: [(a, None, None, None, None) for a in x]
    data = [
        (1, 1, "Benjamin Pellstow", None, alias("B. Pellstow")), (2, 1, "Ben Pellstow", "Benjamin Pellstow", []), (3, 1, "Pellstow, B. E.", None, None), (4, 1, "BenjaminPellstow", " ", alias(None)),
        (5, 1, "Elizabeth Pellstow", "", []), (6, 1, "Betty Pellstow", None, None), (7, 1, "Ivory Heron Academy", "IHA", None), (8, 1, "Academy of the Ivory Heron", None, None), (9, 1, "I. Heron Academy", None, None),
        (10, 1, "Bong Byeol-geum", "봉별금", None), (11, 1, "Pong Byulkeum", None, None), (12, 1, "Byeol-geum Bong", None, None), (13, 1, "Bong Byeol-gon", None, None), (14, 2, "Benjamin Pellstow", None, None),
        (15, 1, None, None, None), (16, None, "Benjamin Pellstow", None, None), (17, 1, "Benjamin Pelstow", None, None), (18, 1, "Dr. Benjamin Pellstow", None, None), (1, 1, "Benjamin Pellstow", None, alias("B. Pellstow")),
        (19, 1, "Elizabeth Pellstow", None, None), (20, 1, "Elizabeth Pellstow", None, None),
        *[(30 + b, b, f"{s} Byeol-gon", None, None) for b, s in ((3, "Gal"), (4, "Mok"), (5, "Tak"))],
    ]
    schema = "entity_id bigint, book_id bigint, canonical string, original_name string, aliases array<struct<from_text: string, to_text: string, apply_mode: string, confidence: double, note: string>>"
    df = spark.createDataFrame(data, schema).withColumn("label", F.lit("clash")).withColumn("node", F.lit(1))
    groups = [[1, 2, 3, 4, 17, 18], [5, 6, 19, 20], [7, 8, 9], [10, 11, 12]]
    want = sorted(((a, b) for g in groups for a in g for b in g if a < b), key=repr)
    got = rows(names.entity_pairs(df))
    assert got == want, (set(want) - set(got), set(got) - set(want))
    assert names.entity_pairs(df.limit(0)).count() == 0


def test_misspelling_that_recurs_in_other_books(spark):
    data = [(100 * b + i, b, name) for b in (1, 2, 3) for i, name in enumerate(["Lorel Duskwick"] * 12 + ["Lora Duskwick"] * 12 + ["Lorel Dusckwick"])]
    frame = spark.createDataFrame(data, "entity_id bigint, book_id bigint, canonical string").withColumn("original_name", F.lit(None).cast("string"))
    frame = frame.withColumn("aliases", F.lit(None).cast("array<struct<from_text: string>>"))
    label = {(r.book_id, r.entity_id % 100): r.label for r in names.link_entities(frame).collect()}
    for b in (1, 2, 3):
        assert label[b, 24] == label[b, 0] == label[b, 11]  # three records hold 'Dusckwick', one in each book
        assert label[b, 12] != label[b, 0]  # as frequent a first name near it is another person


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_korean_forms_agree():
    key = lambda n: {k for kind, k, *_ in nameforms.forms(n) if kind == "sound"}
    assert key("봉별금") & key("Bong, Byul-keum") & key("Pong Byeolkeum") & key("Byeol-geum Bong")
    assert not key("Bing Gyeom-dam") & key("Bing Gyeol-dam")


# 1 -----------------------------------------------------------------------------------------------------------------------

NOUNS = dict(zip("sword gate river lantern crown horse bell tower mirror boat candle rope chain ring book map stone key cloak drum flute net wheel mask".split(), "espada portão rio lampião coroa cavalo sino torre espelho bote vela corda corrente anel livro mapa pedra chave capa tambor flauta rede roda máscara".split()))
SAYINGS = [("{a} hid the {x} behind the {y} before nightfall.", "{a} escondeu o {x} atrás do {y} antes da noite."), ("Nobody believed that {a} had sold the {x} to {b}.", "Ninguém acreditava que {a} vendera o {x} a {b}."), ("{a} paid {n} coins for the {x} and left.", "{a} pagou {n} moedas pelo {x} e saiu.")]


def test_alignment(spark):
    import random

    r = random.Random(7)
    nodes, want, n = [], set(), 0
    for book in range(40):
        people = [f"{x}{book:02d}or" for x in ("Ulma", "Quowy", "Prila", "Corbe", "Jore")]
        for ch in range(8):
            pairs = []
            for _ in range(6):
                s, t = r.choice(SAYINGS)
                x, y = r.sample(sorted(NOUNS), 2)
                a, b = r.sample(people, 2)
                k = r.randint(21, 900)
                pairs.append((s.format(a=a, b=b, x=x, y=y, n=k), t.format(a=a, b=b, x=NOUNS[x], y=NOUNS[y], n=k)))
            ids = list(range(n, n + len(pairs)))
            nodes += [(i, book * 100 + ch, book, "source", f"s{ch:04d}-p0000-t{k:04d}", p[0]) for k, (i, p) in enumerate(zip(ids, pairs))]
            n += len(pairs)
            out = [((i,), p[1]) for i, p in zip(ids, pairs)]
            out[0:2] = [((ids[0], ids[1]), out[0][1][:-1] + "; " + out[1][1])]
            del out[2]
            out[1:3] = out[2:0:-1]
            out.insert(2, ((), f"Nota da tradução: {people[0]} olhou para {people[1]}."))
            for k, (of, t) in enumerate(out):
                nodes.append((n, book * 100 + 50 + ch, book, "translation", f"s{ch:04d}-p0000-t{k:04d}", t))
                want |= {(x, n) for x in of}
                n += 1
    nodes += [nodes[0], (n, 0, 0, "source", "s0000-p0009-t0000", None), (n + 1, 0, 0, "source", "s0000-p0009-t0001", "***")]
    df = spark.createDataFrame(nodes, "node_id bigint, section_id bigint, book_id bigint, edition string, node_key string, text string").withColumn("pair", F.lit("clash"))
    books = spark.createDataFrame([(b, "en", None if b == 3 else "pt") for b in range(40)], "book_id bigint, source_lang string, target_lang string")
    got = {(r.source_node, r.target_node) for r in alignment.align(df, books).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(want), (len(got & want), len(want), len(got - want))
    assert alignment.align(df.limit(0), books.limit(0)).count() == 0


def test_chapters_pair_at_any_distance(spark):
    """Chapters that share only words of many chapters pair wherever they stand, in a book of more chapters than one group holds."""
    import random
    from collections import Counter
    from math import log, sqrt

    r = random.Random(3)
    n, bag = 90, [f"w{i}" for i in range(60)]  # each word in a quarter of the chapters
    told = {c: r.sample(bag, 15) for c in range(n)}
    terms = [(1, "source", c, w, 1 + i % 3) for c, ws in told.items() for i, w in enumerate(ws)]
    terms += [(1, "translation", 1000 + c, w, 1 + i % 3) for c, ws in told.items() for i, w in enumerate(ws)]
    # The translation has the chapters in the opposite order.
    df = spark.createDataFrame([(b, e, s, s if e == "source" else 1089 - s, w, k) for b, e, s, w, k in terms], "book_id bigint, edition string, section_id bigint, at int, term string, tf bigint")
    each = lambda e: F.count(F.when(F.col("edition") == e, 1))
    shared = df.groupBy("book_id", "term").agg(each("source").alias("ds"), each("translation").alias("dt"))
    got = {(x.pair, x.target_section) for x in alignment.chapter_pairs(df, shared).collect()}
    df_ = Counter(w for ws in told.values() for w in ws)
    vec = {c: {w: (1 + log(1 + i % 3)) * log(1 + 2 * n / (2 * df_[w])) for i, w in enumerate(ws)} for c, ws in told.items()}
    norm = {c: sqrt(sum(x * x for x in v.values())) for c, v in vec.items()}
    cos = {(a, b): sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / norm[a] / norm[b] for a in vec for b in vec}
    want = {(a, 1000 + max(range(n), key=lambda b: cos[a, b])) for a in range(n)}
    assert min(df_.values()) > 12 and got == want == {(c, 1000 + c) for c in range(n)}


def test_windows_need_no_joiner(spark):
    """Two sentences that one sentence renders are found by their vectors alone: neighbours, and parts that stand apart."""
    unit = lambda place, *dims: [(1, place, place / 20.0, d, 1.0) for d in dims]
    rows_ = unit(2, 1, 2, 3, 4, 5, 6) + unit(3, 1, 2, 3) + unit(5, 4, 5, 6)  # 2 renders its neighbours 3 and 5
    rows_ += unit(4, 11, 12, 13, 14, 15, 16) + unit(7, 11, 12, 13, 14) + unit(13, 15, 16)  # 4 renders 7 and, moved, 13
    rows_ += unit(6, 21, 22) + unit(9, 21, 22) + unit(8, 31) + unit(11, 41)
    df = spark.createDataFrame(rows_, "pair bigint, place int, pos double, dim bigint, v double")
    cosines = alignment.sentence_cosines(df)
    chosen = alignment.mutual_best(alignment.spans(cosines))
    assert sorted(sorted(r.places) for r in chosen.collect()) == [[2, 3, 5], [4, 7], [6, 9]]
    assert [sorted(r.places) for r in alignment.mutual_best(alignment.widened(chosen, cosines)).collect()] == [[4, 13]]
