"""HTML with the standard library: blocks, profiles, candidates and ranges in document order."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote li div td pre dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("script style svg nav head template noscript".split())
VOID = frozenset("br hr img meta link input source wbr area base col embed track".split())


class Blocks(HTMLParser):
    """Text blocks in document order: tag, path of child numbers, id, classes, bold share, text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self._stack: list[list] = []  # tag, child count, number
        self._skip = 0
        self._open: list[dict] = []
        self._count = 0
        self.title = ""
        self._in_title = False
        self.links: list[tuple[str, str]] = []

    def _path(self) -> str:
        return "/".join(str(x[2]) for x in self._stack)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        number = 0
        if self._stack:
            number = self._stack[-1][1]
            self._stack[-1][1] += 1
        else:
            number, self._count = self._count, self._count + 1
        if tag in VOID:
            if tag == "br" and self._open:
                self._open[-1]["parts"].append("\n")
            return
        self._stack.append([tag, 0, number])
        a = dict(attrs)
        if tag == "title":
            self._in_title = True
        if tag in SKIPPED:
            self._skip += 1
        if tag == "a" and a.get("href"):
            self.links.append((a["href"], ""))
        if tag in BLOCKS and not self._skip:
            self._open.append({"tag": tag, "path": self._path(), "id": a.get("id"), "parts": [], "bold": 0, "depth": len(self._stack)})

    def handle_endtag(self, tag: str) -> None:
        if not any(x[0] == tag for x in self._stack):
            return
        while self._stack:
            closed = self._stack.pop()[0]
            if closed in SKIPPED:
                self._skip = max(0, self._skip - 1)
            if closed == "title":
                self._in_title = False
            while self._open and self._open[-1]["depth"] > len(self._stack):
                self._close(self._open.pop())
            if closed == tag:
                return

    def _close(self, b: dict) -> None:
        text = re.sub(r"[ \t\r\f\v\u00a0]+", " ", "".join(b["parts"]))
        text = re.sub(r" ?\n ?", "\n", text).strip()
        flat = " ".join(text.split())
        if len(flat) >= 2:
            self.rows.append({"tag": b["tag"], "path": b["path"], "id": b["id"], "text": flat, "bold": b["bold"] >= 0.9 * len(flat.replace(" ", ""))})

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        if self._skip or not self._open:
            return
        self._open[-1]["parts"].append(data)
        if any(x[0] in ("b", "strong") for x in self._stack):
            self._open[-1]["bold"] += len("".join(data.split()))

    def close(self) -> None:
        super().close()
        while self._open:
            self._close(self._open.pop())


def parse(text: str | None) -> Blocks:
    p = Blocks()
    p.feed(text or "")
    p.close()
    order = {id(r): i for i, r in enumerate(p.rows)}
    p.rows.sort(key=lambda r: ([int(x) for x in r["path"].split("/") if x], order[id(r)]))
    return p


def without_repeats(texts: list[str]) -> list[str]:
    """Texts that differ from the one before."""
    return [t for i, t in enumerate(texts) if i == 0 or t != texts[i - 1]]


def blocks(df: DataFrame, ident: str, markup: str) -> DataFrame:
    """``ident, block_no, tag, dom_path, element_id, bold, text`` of all text blocks."""
    kind = df.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(key, i, r["tag"], r["path"], r["id"], r["bold"], r["text"]) for key, text in f.itertuples(index=False, name=None) for i, r in enumerate(parse(text).rows)]
            yield pd.DataFrame(rows, columns=[ident, "block_no", "tag", "dom_path", "element_id", "bold", "text"])

    return df.select(ident, markup).mapInPandas(run, f"`{ident}` {kind}, block_no int, tag string, dom_path string, element_id string, bold boolean, text string")


def profiles(df: DataFrame, ident: str, markup: str, most: int = 12) -> DataFrame:
    """One row a document: title, first heading, first bold block, first paragraph, first blocks, text, words, error."""
    kind = df.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, title string, heading string, first_bold string, first_paragraph string, first_blocks array<string>, text string, words int, error string"

    def one(key, text) -> tuple:
        try:
            p = parse(text)
            first = lambda test: next((r["text"] for r in p.rows if test(r)), None)
            texts = without_repeats([r["text"] for r in p.rows])
            whole = "\n".join(texts)
            return key, " ".join(p.title.split()) or None, first(lambda r: r["tag"] in HEADINGS), first(lambda r: r["bold"]), first(lambda r: r["tag"] == "p"), texts[:most], whole, len(whole.split()), None
        except Exception as e:  # a broken document is a row, not the end of the job
            return key, None, None, None, None, [], None, 0, f"{type(e).__name__}: {e}"[:200]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.strip().split(" ")[0].strip("`") for p in re.split(r",\s*(?![^<]*>)", schema)]
        for f in frames:
            yield pd.DataFrame([one(*x) for x in f.itertuples(index=False, name=None)], columns=names)

    return df.select(ident, markup).mapInPandas(run, schema)


def unescape(text: str) -> str:
    return html.unescape(text)
