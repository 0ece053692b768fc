"""Book packages (EPUB, DOCX) with the standard library; each file is one task's row, and a broken one is a row with an error."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.html import HEADINGS, parse, without_repeats

SECTIONS = "file string, section_index int, path string, title string, headings array<string>, paragraphs array<string>, char_count bigint, linear boolean, error string"
MANIFEST = "file string, id string, href string, full_path string, media_type string, properties string, spine_index int, linear boolean"
ENTRIES = "file string, position int, path string, bytes bigint, stored boolean, digest string"
TOC = "file string, play_order int, level int, label string, full_path string, anchor string"
NODES = "file string, path string, spine_index int, paragraph_index int, text_node_index int, node_key string, tag string, text string, global_start bigint, global_end bigint"


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files as ``file, content``; unreadable ones are skipped by the reader."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(folder)
    return found.select(F.col("path").alias("file"), "content")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class Package:
    """An opened EPUB: manifest, spine and contents."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        container = ET.fromstring(self.zip.read("META-INF/container.xml"))
        self.opf_path = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        opf = ET.fromstring(self.zip.read(self.opf_path))
        base = posixpath.dirname(self.opf_path)
        self.items = {}
        for e in opf.iter():
            if _local(e.tag) == "item":
                href = unquote(e.get("href", ""))
                self.items[e.get("id")] = {"id": e.get("id"), "href": href, "full_path": posixpath.normpath(posixpath.join(base, href)), "media_type": e.get("media-type"), "properties": e.get("properties")}
        self.spine = [(e.get("idref"), e.get("linear") != "no") for e in opf.iter() if _local(e.tag) == "itemref"]

    def text(self, path: str) -> str:
        return self.zip.read(path).decode("utf-8", "replace")

    def textual(self) -> Iterator[tuple[int, dict, bool]]:
        for i, (ref, linear) in enumerate(self.spine):
            item = self.items.get(ref)
            if item and ("html" in (item["media_type"] or "") or re.search(r"\.x?html?$", item["href"], re.I)):
                yield i, item, linear

    def toc(self) -> list[tuple[int, str, str, str]]:
        """``level, label, path, anchor`` of the navigation, nested points flattened."""
        out: list[tuple[int, str, str, str]] = []
        for item in self.items.values():
            if (item["media_type"] or "") != "application/x-dtbncx+xml":
                continue
            base = posixpath.dirname(item["full_path"])

            def walk(e: ET.Element, level: int, base: str = base) -> None:
                for x in e:
                    if _local(x.tag) == "navPoint":
                        label = next((" ".join("".join(y.itertext()).split()) for y in x if _local(y.tag) == "navLabel"), "")
                        src = next((y.get("src", "") for y in x if _local(y.tag) == "content"), "")
                        path, _, anchor = src.partition("#")
                        out.append((level, label, posixpath.normpath(posixpath.join(base, unquote(path))), anchor))
                        walk(x, level + 1)
                    elif _local(x.tag) in ("navMap", "ncx"):
                        walk(x, level)

            walk(ET.fromstring(self.zip.read(item["full_path"])), 0)
        return out


def _scan(df: DataFrame, schema: str, rows_of, error_row) -> DataFrame:
    names = [p.strip().split(" ")[0] for p in re.split(r",\s*(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in f[["file", "content"]].itertuples(index=False, name=None):
                try:
                    rows = list(rows_of(name, bytes(content)))
                except Exception as e:
                    rows = error_row(name, f"{type(e).__name__}: {e}"[:200])
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return df.select("file", "content").mapInPandas(run, schema)


def epub_sections(df: DataFrame) -> DataFrame:
    """Sections in spine order: title from the table of contents, else the first heading, else the path."""

    def rows(name: str, content: bytes):
        p = Package(content)
        labels = {path: label for _, label, path, _ in p.toc()}  # the last label of a path counts
        for i, item, linear in p.textual():
            try:
                parsed = parse(p.text(item["full_path"]))
            except KeyError:
                yield name, i, item["full_path"], None, [], [], 0, linear, "missing entry"
                continue
            texts = without_repeats([r["text"] for r in parsed.rows])
            heads = [r["text"] for r in parsed.rows if r["tag"] in HEADINGS]
            yield name, i, item["full_path"], labels.get(item["full_path"]) or (heads[0] if heads else item["href"]), heads, texts, sum(map(len, texts)), linear, None

    return _scan(df, SECTIONS, rows, lambda n, e: [(n, -1, None, None, [], [], 0, False, e)])


def epub_manifest(df: DataFrame) -> DataFrame:
    """Manifest items with their place in the spine (null outside it)."""

    def rows(name: str, content: bytes):
        p = Package(content)
        at = {ref: (i, linear) for i, (ref, linear) in enumerate(p.spine)}
        for item in p.items.values():
            i, linear = at.get(item["id"], (None, None))
            yield name, item["id"], item["href"], item["full_path"], item["media_type"], item["properties"], i, linear

    return _scan(df, MANIFEST, rows, lambda n, e: [])


def epub_toc(df: DataFrame) -> DataFrame:
    return _scan(df, TOC, lambda n, c: [(n, i, *x) for i, x in enumerate(Package(c).toc())], lambda n, e: [])


def epub_nodes(df: DataFrame) -> DataFrame:
    """Text nodes with ids ``sNNNN-pNNNN-tNNNN`` and offsets in the whole text (1 between blocks, 2 between files)."""

    def rows(name: str, content: bytes):
        p, at = Package(content), 0
        for i, item, _ in p.textual():
            for k, r in enumerate(parse(p.text(item["full_path"])).rows):
                yield name, item["full_path"], i, k, 0, f"s{i:04d}-p{k:04d}-t0000", r["tag"], r["text"], at, at + len(r["text"])
                at += len(r["text"]) + 1
            at += 2

    return _scan(df, NODES, rows, lambda n, e: [])


def zip_entries(df: DataFrame) -> DataFrame:
    """Members of packages with size, storage and digest."""

    def rows(name: str, content: bytes):
        z = zipfile.ZipFile(io.BytesIO(content))
        for i, e in enumerate(z.infolist()):
            yield name, i, e.filename, e.file_size, e.compress_type == zipfile.ZIP_STORED, hashlib.sha256(z.read(e)).hexdigest()

    return _scan(df, ENTRIES, rows, lambda n, e: [])


def docx_paragraphs(df: DataFrame) -> DataFrame:
    """Paragraphs of DOCX files with the heading level of their style (null for text)."""

    def rows(name: str, content: bytes):
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
        n = 0
        for p in root.iter():
            if _local(p.tag) != "p":
                continue
            text = " ".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").split())
            style = next((v for s in p.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            m = re.search(r"(?:heading|t[ií]tulo|titre)\s*(\d)", style, re.I)
            if text:
                yield name, n, text, int(m[1]) if m else None, None
                n += 1

    return _scan(df, "file string, paragraph_index int, text string, heading_level int, error string", rows, lambda n, e: [(n, -1, None, None, e)])


def write_zip(members: list[tuple[str, bytes]]) -> bytes:
    """A package: the mimetype first and stored, everything else deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in sorted(members, key=lambda m: m[0] != "mimetype"):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def build_epub(title: str, language: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """A small valid EPUB 3 of chapters ``(title, paragraphs)``."""
    from html import escape

    page = lambda t, ps: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="{language}"><head><title>{escape(t)}</title></head><body><h1>{escape(t)}</h1>' + "".join(f"<p>{escape(p)}</p>" for p in ps) + "</body></html>"
    names = [f"Text/chapter{i + 1}.xhtml" for i in range(len(chapters))]
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    opf = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{language}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">' + "".join(f'<itemref idref="c{i}"/>' for i in range(len(names))) + "</spine></package>"
    ncx = '<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>' + "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, ((t, _), n) in enumerate(zip(chapters, names))) + "</navMap></ncx>"
    nav = '<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol>' + "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for (t, _), n in zip(chapters, names)) + "</ol></nav></body></html>"
    container = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    members = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container.encode()), ("OEBPS/content.opf", opf.encode()), ("OEBPS/toc.ncx", ncx.encode()), ("OEBPS/nav.xhtml", nav.encode())]
    return write_zip(members + [(f"OEBPS/{n}", page(t, ps).encode()) for (t, ps), n in zip(chapters, names)])


def build_docx(paragraphs: list[tuple[str, str | None]]) -> bytes:
    """A small DOCX of paragraphs ``(text, style)``: one ``w:p`` a line of text, style null for plain ones."""
    from html import escape

    line = lambda t, style: "<w:p>" + (f'<w:pPr><w:pStyle w:val="{escape(style)}"/></w:pPr>' if style else "") + f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    body = "".join(line(t, style) for text, style in paragraphs for t in text.split("\n"))
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    types = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    return write_zip([("[Content_Types].xml", types.encode()), ("_rels/.rels", rels.encode()), ("word/document.xml", document.encode())])


def docx_of(sections: DataFrame, key: str, order: str) -> DataFrame:
    """One DOCX a group of chapters (``key``), in order: ``key, content``; a title is a heading, null paragraphs are empty lines."""
    kind = sections.schema[key].dataType.simpleString()

    def one(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[str, str | None]] = []
        for t, ps in f.sort_values(order)[["title", "paragraphs"]].itertuples(index=False):
            rows += ([(t, "Heading1")] if isinstance(t, str) else []) + [(p or "", None) for p in (ps if ps is not None else [])]
        return pd.DataFrame([(k[0], build_docx(rows))], columns=[key, "content"])

    return sections.select(key, order, "title", "paragraphs").groupBy(key).applyInPandas(one, f"`{key}` {kind}, content binary")


def epubs_of(sections: DataFrame, key: str, title: str, language: str) -> DataFrame:
    """One package a book, built where its sections meet: ``key, content``."""
    kind = sections.schema[key].dataType.simpleString()

    def one(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("section_index")
        chapters = [(t or f"{i + 1}", [str(p) for p in ps]) for i, (t, ps) in enumerate(zip(f["title"], f["paragraphs"]))]
        return pd.DataFrame([(k[0], build_epub(str(k[0]) if f[title].isna().all() else str(f[title].dropna().iloc[0]), language, chapters))], columns=[key, "content"])

    return sections.groupBy(key).applyInPandas(one, f"`{key}` {kind}, content binary")
