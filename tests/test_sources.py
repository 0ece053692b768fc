"""Packages, markup, logs, listings and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from folioscope.sources import html, packages, tables
from folioscope.streaming import events

CHAPTERS = [("Chapter 1: The gate", ["First <line>.", "Second line."]), ("Chapter 2: The river", ["Third line.", "Third line."])]


def test_epub_round_trip(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(packages.build_epub("Book", "en", CHAPTERS))
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    files = packages.files(spark, str(tmp_path), "*.epub")
    out = {(r.file.rsplit("/", 1)[-1], r.section_index): r for r in packages.epub_sections(files).collect()}
    assert out["a.epub", 0].title == "Chapter 1: The gate" and out["a.epub", 0].paragraphs == ["Chapter 1: The gate", "First <line>.", "Second line."]
    assert out["a.epub", 1].paragraphs == ["Chapter 2: The river", "Third line."]
    assert out["bad.epub", -1].error
    assert packages.epub_manifest(files).where("spine_index IS NOT NULL").count() == 2
    assert [r.label for r in packages.epub_toc(files).orderBy("play_order").collect()] == [t for t, _ in CHAPTERS]
    nodes = packages.epub_nodes(files).orderBy("global_start").collect()
    assert nodes[0].node_key == "s0000-p0000-t0000" and nodes[0].global_end + 1 == nodes[1].global_start
    first = packages.zip_entries(files).where("position = 0").first()
    assert (first.path, first.stored) == ("mimetype", True)


def test_books_to_packages(spark):
    df = spark.createDataFrame([(1, 0, "A", ["x y", "z w"]), (1, 1, "B", ["q r"])], "book int, section_index int, title string, paragraphs array<string>")
    content = packages.epubs_of(df, "book", "title", "en").first().content
    assert zipfile.ZipFile(io.BytesIO(bytes(content))).namelist()[0] == "mimetype"


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text </w:t></w:r><w:r><w:t>here</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    rows = packages.docx_paragraphs(packages.files(spark, str(tmp_path), "*.docx")).orderBy("paragraph_index").collect()
    assert [(r.text, r.heading_level) for r in rows] == [("Title", 1), ("Text here", None)]


def test_html_blocks(spark):
    page = "<html><head><title>T</title></head><body><nav>skip</nav><h1>Head</h1><script>var x = '</p>';</script><p><b>Bold</b></p><div>a<p>inner text</p></div><p>unclosed<br>two"
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    got = [(r.tag, r.text) for r in html.blocks(df, "id", "html").orderBy("block_no").collect()]
    assert ("h1", "Head") in got and ("p", "inner text") in got and all("skip" not in t and "var" not in t for _, t in got)
    prof = {r.id: r for r in html.profiles(df, "id", "html").collect()}
    assert prof[1].heading == "Head" and prof[1].first_bold == "Bold" and prof[2].words == 0


def test_logs_and_selection(spark, tmp_path):
    (tmp_path / "log.txt").write_text("title: Book\nsword -> espada\nInstructions:\nkeep names\n\nlast note\n")
    rows = tables.log_entries(tables.log_lines(spark, str(tmp_path / "log.txt"))).orderBy("line_no").collect()
    assert [(r.kind, r.left, r.right) for r in rows][:2] == [("field", "title", "Book"), ("replacement", "sword", "espada")]
    got = spark.createDataFrame([("1,3-5,9",), ("all",), ("x",)], "s string").select(tables.numbers_of(F.col("s"), F.lit(6))).collect()
    assert [r[0] for r in got] == [[1, 3, 4, 5], [1, 2, 3, 4, 5, 6], []]
    assert tables.free_name(["a.txt", "a-2.txt"], "a.txt") == "a-3.txt"
    stamps = spark.createDataFrame([("r_02-11-2024_10-00-00.json",), ("r_30-10-2024_10-00-00.json",)], "n string")
    assert tables.newest(stamps, "n", "n").first().n.startswith("r_02-11")


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    spark.conf.set("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    live = events.read_events(spark, str(folder), batch.schema)
    got = events.run_to_memory(events.tumbling(live), "tumbling_out", "complete")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(got) == key(events.tumbling(batch))
    state = events.run_to_memory(events.purchases_after_error(live), "recovered_out", "update")
    final = {r.user_id: r.recovered for r in state.groupBy("user_id").agg(F.max("recovered").alias("recovered")).collect()}
    assert len(final) == batch.select("user_id").distinct().count()


def test_docx_round_trip(spark, tmp_path):
    from folioscope.sources import packages

    df = spark.createDataFrame([("b", 1, "Two & more", ["c"]), ("b", 0, "One", ["a <b>", None, "x\ny"]), ("d", 0, None, None)], "k string, i int, title string, paragraphs array<string>")
    for r in packages.docx_of(df, "k", "i").collect():
        (tmp_path / f"{r.k}.docx").write_bytes(r.content)
    back = packages.docx_paragraphs(packages.files(spark, str(tmp_path), "*.docx"))
    got = [(r.text, r.heading_level) for r in back.where("file LIKE '%b.docx' AND text IS NOT NULL").orderBy("paragraph_index").collect() if r.text]
    assert got == [("One", 1), ("a <b>", None), ("x", None), ("y", None), ("Two & more", 1), ("c", None)]
