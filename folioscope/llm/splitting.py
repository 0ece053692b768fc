"""Problem 6: splitting oversized items at natural boundaries.

Method. A text is cut into tokens (a word with the blanks behind it); the prefix sums of their lengths are the
boundary positions, kept as two sorted arrays (ends of sentences or lines, ends of words). From the start of a piece a
binary search finds the last boundary under the limit, sentence ends first, then words; where neither lies far enough,
the text is cut hard at the limit (not between a character and its combining marks). The next piece starts ``overlap``
characters before the cut.

Defined results: null arrays, null elements and elements within the limit give no pieces; repeated rows of one
(id, index) count once; lengths and offsets are code points of the text as stored. Pieces joined without their
overlaps give the text again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 3_000
OVERLAP = 200

#: A token is a run of non-blanks with the blanks behind it, or leading blanks.
_TOKEN = re.compile(r"\S+\s*|\s+")
#: What closes a sentence, and what may stand behind it.
_STOPS, _CLOSERS = ".!?…", "\"'”’»)]}*_"
_CJK_END = re.compile(r"[。！？]+[」』”]*")


def _ends_sentence(token: str) -> bool:
    """Whether a sentence or a line ends with a token, however many blanks and closing marks stand behind it."""
    word = token.rstrip()
    if len(word) == len(token):
        return False
    return "\n" in token[len(word) :] or word.rstrip(_CLOSERS)[-1:] in tuple(_STOPS)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions after which a sentence (or line) and a word end."""
    tokens = _TOKEN.findall(text)
    words = np.cumsum(np.fromiter((len(t) for t in tokens), np.int64, len(tokens)))
    ends = np.fromiter(map(_ends_sentence, tokens), bool, len(tokens))
    sentences = words[ends]
    inner = [m.end() for m in _CJK_END.finditer(text)]
    if inner:
        sentences = np.unique(np.concatenate([sentences, np.array(inner, np.int64)]))
    return sentences, words


def _hard(text: str, at: int, floor: int) -> int:
    """The limit itself, or the start of the character sequence that would be torn there."""
    cut = at
    while cut > floor and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f" or text[cut - 1] == "\u200d"):
        cut -= 1
    return cut if cut > floor else at


def cut_points(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    levels = boundaries(text)
    pieces, start = [], 0
    while n - start > limit:
        floor, end = start + overlap, 0
        for level in levels:
            i = int(np.searchsorted(level, start + limit, "right")) - 1
            if i >= 0 and level[i] > floor:
                end = int(level[i])
                break
        end = end or _hard(text, start + limit, floor)
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def split_oversized(df: DataFrame, id_col: str = "chapter_id", array_col: str = "paragraphs", limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all array elements over the limit: id, paragraph_index, piece_no, start_at, end_at, piece.

    The length test runs in the scan's stage, so only oversized elements are moved and reach Python.
    """
    kind = df.schema[id_col].dataType.simpleString()
    large = (
        df.select(F.col(id_col), F.posexplode(F.col(array_col)).alias("paragraph_index", "_text"))
        .where(F.length("_text") > limit)
        .withColumn("paragraph_index", F.col("paragraph_index").cast("bigint"))
        .dropDuplicates([id_col, "paragraph_index"])
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, index, text in f.itertuples(index=False, name=None):
                spans = cut_points(text, limit, overlap)
                yield pd.DataFrame({
                    id_col: [key] * len(spans),
                    "paragraph_index": [index] * len(spans),
                    "piece_no": range(len(spans)),
                    "start_at": [a for a, _ in spans],
                    "end_at": [b for _, b in spans],
                    "piece": [text[a:b] for a, b in spans],
                })

    return large.mapInPandas(run, f"`{id_col}` {kind}, paragraph_index bigint, piece_no int, start_at bigint, end_at bigint, piece string")


def oversized(df: DataFrame, id_col: str = "chapter_id", array_col: str = "paragraphs", limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``(id, paragraph_index)`` of the elements that were cut: those whose first piece is not their last."""
    pieces = split_oversized(df, id_col, array_col, limit, overlap)
    return pieces.where(F.col("piece_no") == 1).select(id_col, "paragraph_index")
